"""Tiles of nearest vectors against all pairs in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions.vector import buckets
from recollect.operators import entity, evolution, nearest, search


@pytest.fixture
def small_tiles(monkeypatch):
    """Several tiles a value, and several steps in a tile."""
    monkeypatch.setattr(nearest, "TILE", 20)
    monkeypatch.setattr(nearest, "ROWS", 7)
    monkeypatch.setattr(nearest, "FIRST", 3)


@pytest.fixture(scope="module")
def rows():
    """Users with many rows, one and none; equal vectors, zero ones, nulls, another size."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(90):
        v = rng.normal(size=4).round(1).tolist()
        v = [0.0] * 4 if i % 17 == 0 else [1.0, 0.0, 0.0, 0.0] if i % 6 == 0 else v[:3] if i % 19 == 0 else v
        out.append((i, None if i % 23 == 0 else [None, *v[1:]] if i % 29 == 5 else v, "abcd"[0 if i < 50 else 1 if i < 80 else 2 if i < 89 else 3]))
    return out


def pairs(a, b):
    for i, v, u in a:
        for j, w, x in b:
            if u == x and v and w and None not in v and None not in w and any(v) and any(w):
                s = float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))) if len(v) == len(w) else 0.0
                yield i, j, round(min(1.0, max(-1.0, s)), 9)


def best(found, k):
    out = {}
    for i, j, s in sorted(found, key=lambda p: (p[0], -p[2], p[1])):
        if len(out.setdefault(i, [])) < k:
            out[i].append((j, s))
    return {(i, j): s for i, x in out.items() for j, s in x}


def near(a, b):
    assert a.keys() == b.keys() and all(abs(a[p] - b[p]) < 2e-9 for p in a)


@pytest.mark.parametrize("least", [0.3, -0.5])
def test_best_of_all_tiles(spark, small_tiles, rows, least):
    e = spark.createDataFrame(rows, "id long, vector array<double>, u string")
    q = e.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), "u")
    tiles = nearest.best_in_tiles(q, e, 4, least, "u").collect()
    near(best([tuple(r) for r in tiles], 4), best([p for p in pairs(rows, rows) if p[0] != p[1] and p[2] >= least], 4))
    assert len(tiles) == len({(r["query_id"], r["id"]) for r in tiles}) and len(tiles) < 4 * 9 * len(rows)
    # no value: all meet, by names as well
    named = e.select(F.concat(F.lit("k"), "id").alias("id"), "vector")
    got = nearest.best_in_tiles(named.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), named, 1, 0.9, same=True).collect()
    one = [(f"k{i}", v, "") for i, v, _ in rows]
    near(best([tuple(r) for r in got], 1), best([p for p in pairs(one, one) if p[2] >= 0.9], 1))


def test_links_of_a_large_user_are_not_pairs_in_the_shuffle(spark, small_tiles, rows):
    e = spark.createDataFrame(rows, "id long, vector array<double>, user_id string")
    got = evolution.zettel_links(e)
    want = best([p for p in pairs(rows, rows) if p[0] != p[1] and p[2] >= 0.3], 5)
    near({(r["source_id"], r["target_id"]): r["score"] for r in got.collect()}, want | {(j, i): s for (i, j), s in want.items()})
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "FlatMapCoGroupsInArrow" in plan


def test_approximate_search_keeps_the_best_of_shared_buckets(spark, small_tiles, rows):
    e = spark.createDataFrame([(i, [float(x or 0) for x in (v or [0.0] * 4)], u) for i, v, u in rows], "id long, vector array<double>, u string")
    b = {r["id"]: set(r["b"]) for r in e.select("id", buckets(F.col("vector"), 3, 2).alias("b")).collect()}
    plain = [(i, [float(x or 0) for x in (v or [0.0] * 4)], "") for i, v, _ in rows]
    want = best([(i, j, max(0.0, s)) for i, j, s in pairs(plain, plain) if b[i] & b[j] and s >= 0.5], 3)
    got = search.approximate_top_k(e, e.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), 3, 0.5, 3, 2)
    assert got.select("query_id", "id").distinct().count() == got.count()
    near({(r["query_id"], r["id"]): r["score"] for r in got.collect()}, want)


def test_entities_are_compared_with_all_known(spark, small_tiles):
    """Vectors at the least cosine meet even if no bucket holds both."""
    rng = np.random.default_rng(8)
    known = [(i, f"name {i}", rng.normal(size=8).tolist()) for i in range(60)]
    new = [(i, f"other {i}" if i else "NAME 3", (np.array(known[i][2]) + rng.normal(size=8) * 0.28).tolist()) for i in range(60)]
    got = {r["key"]: (r["id"], r["how"]) for r in entity.match_entities(spark.createDataFrame(new, "key long, text string, vector array<double>"), spark.createDataFrame(known, "id long, text string, vector array<double>"), 0.8).collect()}
    want = best([p for p in pairs([(i, v, "") for i, _, v in new], [(i, v, "") for i, _, v in known]) if p[2] >= 0.8], 1)
    assert got.pop(0) == (3, "exact")
    assert got == {i: next(((j, "similar") for (a, j) in want if a == i), (None, "new")) for i in range(1, 60)} and len(want) > 20
