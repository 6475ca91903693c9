import math
import random
from collections import Counter, defaultdict

import duckdb
import pandas as pd

from recollect.llm.mixing import BLOCK_TOKENS, PHI, mix, mix_documents, oracle, schedule

from .conftest import DOCS, prose


def corpus(rng, sizes):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, prose(rng, rng.randint(1, 60)), "en", source, 0))
            i += 1
    return rows


def test_against_sql(spark):
    rows = corpus(random.Random(1), {"a": 300, "b": 60, "c": 9, None: 20, "z": 1}) + [(9000, None, None, "empty", None), (9001, "", None, "empty", None), (None, "no id here", "en", "b", 3)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(tuple(-1 if v is None else v for v in r) for r in mix(docs, block_tokens=100).collect())
    db = duckdb.connect()
    db.register("docs_df", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    want = sorted(tuple(-1 if v is None else v for v in r) for r in db.execute(f"SELECT slot, source, epoch, block, doc_id, first_token, tokens FROM ({oracle(100, docs='docs_df')})").fetchall())
    assert got == want and {r[4] for r in got} == {-1 if r[0] is None else r[0] for r in rows}


def test_schedule_against_a_loop(spark):
    tokens = {"a": 50_000, "b": 7_000, "c": 900}
    rows = [(s, t, max(1, math.ceil(t / 100.0))) for s, t in tokens.items()]
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = schedule(spark.createDataFrame(rows, "source string, source_tokens long, n_blocks long"), weights, block_tokens=100).orderBy("slot").collect()
    n = max(math.ceil(t / 100.0 / weights[s]) for s, t in tokens.items())
    count, want = Counter(), []
    for i in range(n):
        u = i * PHI - math.floor(i * PHI)
        s = "a" if u < 0.5 else "b" if u < 0.8 else "c"
        k = math.ceil(tokens[s] / 100.0)
        want.append((i, s, count[s] // k, count[s] % k))
        count[s] += 1
    main = [tuple(r) for r in got if r["slot"] < n]
    assert main == want
    tail = [tuple(r) for r in got if r["slot"] >= n]
    assert tail == [(n + j, "a", 0, count["a"] + j) for j in range(500 - count["a"])]
    for i in range(0, n, 37):  # low discrepancy: any prefix is close to the weights
        have = Counter(s for _, s, *_ in want[: i + 1])
        assert all(abs(have[s] - w * (i + 1)) < 6 for s, w in weights.items())


def test_blocks_hold_equal_tokens(spark):
    """Every block but a source's last is full, and the pieces of an epoch are each document's tokens, once."""
    rows = corpus(random.Random(5), {"a": 150, "b": 40}) + [(5000, "tok " * 1000, "en", "a", 0)]
    got = mix(spark.createDataFrame(rows, DOCS), block_tokens=100).collect()
    held, pieces = Counter(), defaultdict(list)
    for r in got:
        held[r["source"], r["slot"], r["block"]] += r["tokens"]
        if r["epoch"] == 0:
            pieces[r["doc_id"]].append((r["first_token"], r["tokens"]))
    last = {s: max(b for x, _, b in held if x == s) for s in ("a", "b")}
    assert all(n == 100 for (s, _, b), n in held.items() if b < last[s]) and all(0 < n <= 100 for n in held.values())
    for i, text, *_ in rows:
        at = 0
        for first, n in sorted(pieces[i]):
            assert first == at
            at += n
        assert at == len(text.split())


def test_budget(spark):
    rows = corpus(random.Random(7), {"a": 200, "b": 60})
    docs = spark.createDataFrame(rows, DOCS)
    weights = {"a": 0.999, "b": 0.001}
    for budget in (100, 2_000, 30_000):
        got = mix(docs, weights, block_tokens=100, budget_tokens=budget).collect()
        assert {r["slot"] for r in got} == set(range(budget // 100))
        assert budget - 100 * len({r["epoch"] for r in got}) <= sum(r["tokens"] for r in got) <= budget


def test_order_of_documents(spark):
    """What is written is in the order of the slots, file by file."""
    rows = corpus(random.Random(9), {"a": 120, "b": 30, "c": 5})
    docs = spark.createDataFrame(rows, DOCS)
    slots = defaultdict(list)
    for r in mix(docs, block_tokens=64).collect():
        if r["first_token"] == 0:
            slots[r["doc_id"]].append(r["slot"])
    left = {i: sorted(s) for i, s in slots.items()}
    order = [left[r["doc_id"]].pop(0) for r in mix_documents(docs, block_tokens=64).collect()]
    assert order == sorted(order) and not any(left.values())


def test_documents_are_dealt_as_often_as_scheduled(spark):
    rows = corpus(random.Random(3), {"a": 200, "b": 30})
    rows += [rows[0], rows[0], rows[5]]
    docs = spark.createDataFrame(rows, DOCS)
    want = Counter(r["doc_id"] for r in mix(docs, block_tokens=64).collect() if r["first_token"] == 0)
    out = mix_documents(docs, block_tokens=64)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == want
    assert set(want) == {r[0] for r in rows}
    share = defaultdict(int)
    for r in mix(docs, {"a": 0.25, "b": 0.75}, block_tokens=64).collect():
        share[r["source"]] += r["tokens"]
    assert abs(share["b"] / sum(share.values()) - 0.75) < 0.03


def test_edges(nasty, empty):
    got = mix(nasty).collect()
    assert Counter(r["doc_id"] for r in got if r["epoch"] == 0 and r["first_token"] == 0) == Counter(r["doc_id"] for r in nasty.select("doc_id").collect())
    assert mix_documents(nasty).columns == nasty.columns
    assert {r["doc_id"] for r in mix_documents(nasty).collect()} == {r["doc_id"] for r in nasty.select("doc_id").collect()}
    assert mix(empty).count() == 0 and mix_documents(empty).count() == 0 and BLOCK_TOKENS > 0
