import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ly", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in any column, empty and blank texts, a long one, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 80)
    rows = [
        (1, same, "en", "a"), (1, same, "en", "a"), (2, same, "en", "a"), (3, same + " once", None, "b"), (None, same, "en", "a"), (None, None, None, None), (4, None, "en", "b"), (5, "", "de", None), (6, " \n\t ", "de", "b"),
        (7, long, "en", "b"), (8, prose(rng, 60), "en", "c"), (9, "word " * 400, "fr", "c"), (10, "x" * 5000, "fr", "c"), (11, "日本語 テキスト \U0001f600 é", "fr", "c"), (12, "one", "en", "c"), (12, "two different texts of one id", "en", "c"),
    ]
    extra = "owner long, n long, keep boolean, id long, tag string, block long, u1 string, band int, f0 long, ids string, spans string, part string, good int, token long"
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *(None,) * 13, 7) for r in rows], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
