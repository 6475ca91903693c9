import random

import numpy as np
import pyarrow as pa

from recollect.llm.language_id import Parser, identify, labelled_sample, normalise

from .conftest import DOCS


def tongue(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


TONGUES = {"xa": ["ka", "lo", "mi", "tek"], "yb": ["ou", "shra", "ka", "vel"], "zc": ["ñu", "ri", "lo", "bo"]}


def naive_phrases(sample, text):
    """Greedy longest matches, looked up by substring search."""
    sample, count = normalise(sample), 0
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at += n
        count += 1
    return count


def test_phrases_against_naive():
    rng = random.Random(2)
    samples = {k: tongue(rng, v, 150) for k, v in TONGUES.items()}
    parser = Parser(samples)
    texts = [tongue(rng, rng.choice(list(TONGUES.values())), rng.randint(1, 120)) for _ in range(40)] + ["", "q", "日本 x", "123 !!", "KA lo\tMI"]
    texts += [tongue(rng, TONGUES["xa"], 3000)]
    got, chars = parser.phrases(pa.array(texts))
    want = np.array([[naive_phrases(samples[k], t) for k in parser.languages] for t in texts])
    assert (got == want).all() and chars.tolist() == [len(t) for t in texts]


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(i, tongue(rng, TONGUES[k], rng.randint(5, 200)), k, "s", 0) for i in range(300) for k in [rng.choice(list(TONGUES))]]
    docs = spark.createDataFrame(rows, DOCS)
    samples = labelled_sample(docs, 3000, 20)
    assert set(samples) == set(TONGUES) and all(len(t) <= 3000 for t in samples.values())
    got = {r["doc_id"]: r["language"] for r in identify(docs, samples).collect()}
    unseen = [(i, k) for i, t, k, *_ in rows if t not in samples[k]]
    assert len(unseen) > 200 and sum(got[i] == k for i, k in unseen) / len(unseen) > 0.97


def test_sample_is_bounded(spark):
    """Rows of one id over and over, and long documents: neither bound is passed, and the sample is the documents in their order."""
    rows = [(1, "ab " * 50, "xa", "s", 0)] * 3000 + [(i, f"t{i} " * 400, "xa", "s", 0) for i in range(2, 40)] + [(100, "q " * 30_000, "yb", "s", 0), (101, None, "yb", "s", 0), (102, "", "yb", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = labelled_sample(docs, 5000, 4000)
    assert len(got["xa"]) == 5000 and got["yb"] == ("q " * 30_000)[:5000]
    order = [r["doc_id"] for r in docs.filter("lang = 'xa'").selectExpr("doc_id", "xxhash64(doc_id) h").distinct().orderBy("h", "doc_id").collect()]
    text = {r[0]: r[1] for r in rows if r[0] < 100}
    want = " ".join(t for i in order for t in [text[i]] * (3000 if i == 1 else 1))
    assert got["xa"] == want[:5000]
    assert labelled_sample(docs, 5000, 1)["xa"] == text[order[0]][:5000]


def test_edges(nasty, empty):
    rows = identify(nasty).collect()
    assert len(rows) == nasty.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[7]["language"] == "en" and by[4]["language"] is None and by[5]["language"] is None and by[5]["n_chars"] == 0
    assert identify(empty).count() == 0
    assert {r["language"] for r in identify(nasty.limit(3), {}).collect()} == {None}
    one = identify(nasty.filter("doc_id = 7"), {"en": "some text"}).collect()[0]
    assert one["language"] == "en" and one["runner_up"] is None


def test_any_number_of_languages_and_scripts():
    """What does not fit into the table is parsed by its transitions, with the same phrases; wide alphabets at the default bounds."""
    rng = random.Random(11)
    samples = {k: tongue(rng, v, 150) for k, v in TONGUES.items()}
    texts = [tongue(rng, rng.choice(list(TONGUES.values())), rng.randint(1, 120)) for _ in range(30)] + ["", "q", "日本 x", "123 !!", "ñu KA"]
    want, _ = Parser(samples).phrases(pa.array(texts))
    for cells in (0, 20_000, 60_000):
        parser = Parser(samples, cells)
        assert len(parser.sparse) > 0
        assert (parser.phrases(pa.array(texts))[0] == want).all()
    wide = {f"latin{i}": tongue(rng, list(TONGUES.values())[i], 8000)[:48_000] for i in range(3)}
    wide["han"] = "".join(chr(0x4E00 + int(2800 * rng.random() ** 2)) for _ in range(48_000))
    parser = Parser(wide)
    got, chars = parser.phrases(pa.array([wide["han"][100:400] + "。", wide["latin1"][50:350]]))
    assert parser.languages[int(got[0].argmin())] == "han" and parser.languages[int(got[1].argmin())] == "latin1"
    assert got[0].tolist() == [naive_phrases(wide[k], wide["han"][100:400] + "。") for k in parser.languages]
