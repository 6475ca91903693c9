import random

import corpus_pipeline
from recollect.llm.bpe import VOCABULARY, Codec, read_vocabulary
from recollect.llm.mixing import mix

from .conftest import DOCS, prose
from .test_quality_rules import naive
from .test_substring import brute as duplicate_words


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.randint(20, 300)), "en", rng.choice(["a", "a", "a", "b"]), 0) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "b", 0) for i in range(5)] + [(200 + i, rows[i][1] + " tail", "en", "b", 0) for i in range(10, 15)]
    rows += [(120 + i, f"{prose(rng, 120)} {passage} {prose(rng, 150)}", "en", "a", 0) for i in range(6)]
    rows += [(130, "junk " * 500, "en", "a", 0), (131, None, "en", None, None), (132, "", None, "b", 0), (None, prose(rng, 30), None, None, None)]
    rows = [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d, _ in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe_encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = {n: [(r["doc_id"], r["text"]) for r in seen[n].select("doc_id", "text").collect()] for n in list(seen)[:-1]}
    assert sorted(out["quality_rules"], key=str) == sorted([(i, t) for i, t, *_ in rows if naive(t) is None], key=str)
    gone = {100 + i for i in range(5)} | {200 + i for i in range(10, 15)}
    assert sorted(out["near_dedup"], key=str) == sorted([x for x in out["quality_rules"] if x[0] not in gone], key=str)
    cut = duplicate_words([x for x in out["near_dedup"] if x[0] is not None])
    assert set(cut) == {121, 122, 123, 124, 125}
    want = [(i, " ".join(w for k, w in enumerate(t.split()) if k not in cut.get(i, ()))) for i, t in out["near_dedup"]]
    assert sorted(((i, " ".join(t.split())) for i, t in out["substring_dedup"]), key=str) == sorted(want, key=str)
    dealt = sorted((r["doc_id"] for r in mix(seen["substring_dedup"]).filter("first_token = 0").collect()), key=str)
    assert sorted((i for i, _ in out["mixing"]), key=str) == dealt and set(dealt) == {i for i, _ in out["substring_dedup"]}
    codec = Codec(read_vocabulary(VOCABULARY))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in seen["bpe_encoding"].collect()) == sorted((str(i), codec.encode(t)) for i, t in out["mixing"])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got.collect()) == sorted((str(r["doc_id"]), r["ids"]) for r in seen["bpe_encoding"].collect())


def test_contract():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_near_dedup_goes_by_parts(spark, monkeypatch):
    """At the tables' sizes of some GB the stage compares by parts, a share of all pairs, and keeps the same rows."""
    from math import comb

    from recollect.llm import simhash

    for n in (200_000, simhash.TILE_ROWS):
        by = simhash.parts(n)
        assert by and sum(sum(comb(w, k) for k in range(r + 1)) / 2**w for _, w, r in by) < 0.15
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(40, 120)), "en", "a", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " tail", "en", "b", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    whole = sorted(r["doc_id"] for r in stage(spark, docs, "").collect())
    monkeypatch.setattr(simhash, "parts", lambda n, radius: by)
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == whole and len(whole) < len(rows)
