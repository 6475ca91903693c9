import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.llm.quality_model import CERTAIN, _features, classify, content_view, labels_of, metadata_view, score, surest, train

from .conftest import DOCS, prose


def corpus(rng, n):
    docs, good = [], {}
    for i in range(n):
        bad = rng.random() < 0.35
        words = prose(rng, rng.randint(30, 90)).split()
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "junkword", "spamlink"]))
        source = rng.choice(["farm1", "farm2"]) if rng.random() < (0.8 if bad else 0.1) else rng.choice(["news", "wiki"])
        docs.append((i, " ".join(words), "en", source, 0))
        good[i] = int(not bad)
    return docs, good


def test_held_out_accuracy_and_calibration(spark):
    docs, good = corpus(random.Random(4), 1500)
    labels = [(i, g, 0) for i, g in good.items() if i % 5 == 0]
    df = spark.createDataFrame(docs, DOCS)
    got = {r["doc_id"]: r for r in classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 1500
    rest = [i for i in good if i % 5]
    p = np.array([got[i]["score"] for i in rest])
    y = np.array([good[i] for i in rest])
    assert ((p >= 0.5) == y).mean() > 0.95
    assert np.mean([got[i]["keep"] for i in rest if good[i]]) > 0.95
    assert abs(p.mean() - y.mean()) < 0.05 and np.mean((p - y) ** 2) < 0.05
    for view in ("content_score", "metadata_score"):
        assert ((np.array([got[i][view] for i in rest]) >= 0.5) == y).mean() > 0.75


def test_a_round_against_brute_force(spark):
    """What each view hands over: its surest documents without a label, found by scoring and sorting them one by one."""
    docs, good = corpus(random.Random(8), 900)
    docs += [docs[5], docs[7], (None, "no id", "en", "news", 0)]
    df = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, g, 0) for i, g in good.items() if i % 6 == 0], "doc_id long, quality int, toxic int")
    model = train(df, labels, rounds=0)
    taken = [(1, 0), (5, 0), (5, 1), (8, 1)]
    quota = [[12, 30], [9, 25]]
    want = set()
    for view in (0, 1):
        scored = {}
        for i, text, lang, source, _ in docs:
            if i is None or i % 6 == 0 or (i, view) in taken:
                continue
            z = model.logits(content_view(pa.array([text])), metadata_view([source], [lang], pa.array([text])))[0, view]
            scored[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        ranks = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in scored], "i long").selectExpr("i", "xxhash64(i) as h").collect()}
        for cls in (0, 1):
            sure = sorted((-(p if cls else 1 - p), ranks[i], i) for i, p in scored.items() if (p >= 0.5) == bool(cls) and max(p, 1 - p) >= CERTAIN)
            want |= {(i, view, cls) for _, _, i in sure[: quota[view][cls]]}
    got = {tuple(r) for r in surest(df, labels_of(labels), model, taken, quota).collect()}
    assert got == want and {v for _, v, _ in got} == {0, 1} and {c for *_, c in got} == {0, 1}


def test_rounds_teach_the_other_view(spark):
    """Few labels, a view that knows the label from the source alone and one that has hundreds of telling words to learn: labels cross, and accuracy rises."""
    rng = random.Random(6)
    bad_words = [f"junk{k}" for k in range(150)]
    docs, good = [], {}
    for i in range(2400):
        bad = rng.random() < 0.4
        words = prose(rng, rng.randint(30, 60)).split() + ([rng.choice(bad_words) for _ in range(3)] if bad else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words), "en", rng.choice(["farm1", "farm2"]) if bad == (rng.random() < 0.98) else rng.choice(["news", "wiki"]), 0))
        good[i] = int(not bad)
    df = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, g, 0) for i, g in good.items() if i % 12 == 0], "doc_id long, quality int, toxic int")
    acc, models = {}, {}
    for rounds in (0, 3):
        models[rounds] = train(df, labels, rounds=rounds, hand_over=500)
        got = {r["doc_id"]: r for r in score(df, models[rounds]).collect()}
        acc[rounds] = [np.mean([(got[i][v] >= 0.5) == bool(good[i]) for i in good if i % 12]) for v in ("content_score", "score")]
    assert models[0].handed == [] and all(m > 100 for _, m in models[3].handed[:2])
    assert (models[3].content[0] != models[0].content[0]).any()
    assert acc[3][0] >= acc[0][0] + 0.1 and acc[3][1] >= acc[0][1] - 0.005


def test_bounds_hold_for_repeated_ids(spark):
    """20,000 rows of one id are one document of the fit."""
    docs, good = corpus(random.Random(3), 300)
    many = spark.createDataFrame(docs, DOCS).unionByName(spark.createDataFrame([docs[4]], DOCS).crossJoin(spark.range(20_000)).select("doc_id", "text", "lang", "source", "n_chars"))
    own, (a, b) = _features(many, list(range(60)))
    assert own.tolist() == list(range(60)) and len(a.at) == len(b.at) == 61
    labels = spark.createDataFrame([(i, g, 0) for i, g in good.items() if i < 150], "doc_id long, quality int, toxic int")
    assert all(max(h) <= 20 for h in train(many, labels, labelled=100, hand_over=20, rounds=2).handed)


def test_labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, 0), (5, 1, None), (None, 1, 0)]
    got = {r["doc_id"]: r["good"] for r in labels_of(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_edges(spark, nasty, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(i, i % 2, 0) for i in range(1000, 1100)], "doc_id long, quality int, toxic int")
    more = nasty.unionByName(spark.createDataFrame(corpus(random.Random(2), 100)[0], DOCS).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    for docs in (nasty, empty, more):
        rows = classify(docs, labels).collect()
        assert len(rows) == docs.count() and all(r["keep"] is not None for r in rows)
    none = classify(nasty, labels.limit(0)).collect()
    assert all(r["keep"] and r["score"] is None for r in none)
