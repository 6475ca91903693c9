"""How often texts are read and what is shuffled, and that the rows are the same for it."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as tx
from recollect.functions.vector import hash_embed
from recollect.operators import search


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_bm25_cuts_texts_into_words_once(spark):
    texts = ["Boxes of needed boxes", "a box", "needs, needed; NEEDING", "", None, "running runs run é工", "need" + "s" * 3, "of of of"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    q = spark.createDataFrame([(0, "need boxes"), (1, "run é of of"), (2, "nothing")], "query_id long, query string")
    df = search.bm25(d, q)
    assert not [line for line in plan(df).split("\n") if "regexp_extract_all(" in line and "text#" in line]
    words = {r["id"]: list(r["w"]) for r in d.filter("text is not null").select("id", tx.lemmas(F.col("text")).alias("w")).collect()}
    terms = {r["query_id"]: Counter(r["w"]) for r in q.select("query_id", tx.lemmas(F.col("query")).alias("w")).collect()}
    n, mean = len(texts), sum(map(len, words.values())) / len(words)
    want = {}
    for k, ts in terms.items():
        for i, w in words.items():
            score = 0.0
            for t, weight in ts.items():
                f, m = w.count(t), sum(t in x for x in words.values())
                score += math.log((n - m + 0.5) / (m + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(w) / mean)) * weight
            if score > 0:
                want[k, i] = score
    got = {(r["query_id"], r["id"]): r["score"] for r in df.collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=2e-9) for p in got) and len(got) == 5


@pytest.mark.parametrize("again", [False, True])
def test_term_counts_are_added_up_before_the_shuffle(spark, again):
    rows = [(1, "a b a"), (2, "b"), (3, None), (4, ""), (5, "a é é")] + ([(1, "a c"), (2, None)] if again else [])
    d = spark.createDataFrame(rows, "id long, text string")
    df = search.term_counts(d, tx.tokenize(F.col("text")))
    shuffles = [line for line in plan(df).split("\n") if "Exchange" in line]
    tf = Counter(w for _, t in rows for w in (t or "").split())
    ids = {w: {i for i, t in rows if w in (t or "").split()} for w in tf}
    assert {r["term"]: (r["df"], r["tf"]) for r in df.collect()} == {w: (len(ids[w]), tf[w]) for w in tf}
    # a row a term and document is shuffled only where ids are repeated
    assert len(shuffles) == 1 + again and any("id#" in line for line in shuffles) == again


def test_embedding_of_texts_over_several_slices(spark):
    texts = ["to be or not", None, "x " * 250_000 + "y", "", "not to be", "z " * 210_000]
    got = [r["v"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1).select("i", hash_embed(F.col("t")).alias("v")).orderBy("i").collect()]
    again = [r["v"] for t in texts for r in spark.createDataFrame([(t,)], "t string").select(hash_embed(F.col("t")).alias("v")).collect()]
    assert got == again and got[1] == got[3] == [0.0] * 128 and max(got[5]) == 1.0
