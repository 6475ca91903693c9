import random

import pyarrow as pa

from recollect.llm.arrow_text import words
from recollect.llm.substring import MIN_WORDS, anchors, cut, drop_duplicate_spans, duplicate_spans, windows_with

from .conftest import DOCS, prose


def brute(rows):
    """Words of each document covered by windows that stand earlier: {doc_id: set of words}."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = text.split()
        covered = set()
        for s in range(len(w) - MIN_WORDS + 1):
            key = tuple(w[s : s + MIN_WORDS])
            if key in seen:
                covered.update(range(s, s + MIN_WORDS))
            seen.add(key)
        if covered:
            out[i] = covered
    return out


def corpus(rng):
    passages = [prose(rng, n) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 90))]
        rows.append((i, " ".join(parts)))
    rows += [(60, rows[3][1]), (61, "tick tock " * 90), (62, rows[7][1] + "\n\n" + rows[8][1]), (63, passages[4][:900])]
    return rows


def test_spans_and_factors_against_brute_force(spark):
    rows = corpus(random.Random(4))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = duplicate_spans(docs).collect()
    covered, text = {}, {i: t.split() for i, t in rows}
    for r in got:
        covered.setdefault(r["doc_id"], set()).update(range(r["span_start"], r["span_end"]))
        assert r["span_start"] <= r["factor_start"] < r["factor_end"] <= r["span_end"] and r["span_end"] - r["span_start"] >= MIN_WORDS
        n = r["factor_end"] - r["factor_start"]
        assert text[r["doc_id"]][r["factor_start"] : r["factor_end"]] == text[r["ref_doc_id"]][r["ref_start"] : r["ref_start"] + n]
        assert (r["ref_doc_id"], r["ref_start"]) < (r["doc_id"], r["factor_start"])
    assert covered == brute(rows)
    for i in covered:  # the factors of a span follow one another without a gap
        factors = sorted({(r["factor_start"], r["factor_end"]) for r in got if r["doc_id"] == i})
        assert set().union(*(range(a, b) for a, b in factors)) == covered[i]
        assert all(b <= c for (_, b), (c, _) in zip(factors, factors[1:]))


def parse(rows):
    """A naive greedy parser: (doc, factor_start, factor_end, ref_doc, ref_start) of every factor, text by text, word by word."""
    first, text = {}, {i: t.split() for i, t in rows}
    for i, w in sorted(text.items()):
        for s in range(len(w) - MIN_WORDS + 1):
            first.setdefault(tuple(w[s : s + MIN_WORDS]), (i, s))
    out = set()
    for i, w in sorted(text.items()):
        owner = min(k for k, v in text.items() if v == w)
        if owner != i and len(w) >= MIN_WORDS:
            out.add((i, 0, len(w), owner, 0))
            continue
        at, done = 0, 0
        while at <= len(w) - MIN_WORDS:
            ref = first[tuple(w[at : at + MIN_WORDS])]
            if ref == (i, at):
                at += 1
                continue
            end = at + MIN_WORDS
            # as long as the next word is the reference's next, and the reference has that window nowhere before
            while end < len(w) and first[tuple(w[end + 1 - MIN_WORDS : end + 1])] == (ref[0], ref[1] + end + 1 - MIN_WORDS - at):
                end += 1
            begin = max(at, done)
            out.add((i, begin, end, ref[0], ref[1] + begin - at))
            # the windows across the factor's end are tried next
            at, done = end - MIN_WORDS + 1, end
    return out


def test_factors_against_a_naive_greedy_parser(spark):
    for seed in (8, 9, 10):
        rng = random.Random(seed)
        rows = corpus(rng)
        base = rows[5][1].split()
        rows += [(70 + k, " ".join(w if rng.random() > 0.012 else "edit%d" % rng.randrange(99) for w in base * 3)) for k in range(8)]
        a, b = prose(rng, 70), prose(rng, 70)
        rows += [(90, a), (91, b), (92, f"{a} {b} new end")]
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
        got = duplicate_spans(docs).collect()
        factors = {(r["doc_id"], r["factor_start"], r["factor_end"], r["ref_doc_id"], r["ref_start"]) for r in got}
        assert factors == parse(rows) and {(92, 0, 70, 90, 0), (92, 70, 140, 91, 0)} <= factors
        assert {(r["span_start"], r["span_end"]) for r in got if r["doc_id"] == 92} == {(0, 140)}


def test_second_hash_tells_windows_apart():
    w = words(pa.array([" ".join(f"w{k}" for k in range(60))]), lower=False)
    chosen = [anchors(w)[0]]
    h, g, at = windows_with(w, chosen)
    assert at.tolist() == list(range(11)) and len(set(h.tolist())) == len(set(g.tolist())) == 11 and not set(h.tolist()) & set(g.tolist())


def test_very_long_texts(spark):
    rng = random.Random(2)
    passage, long = prose(rng, 120), prose(rng, 200_000)
    rows = [(1, f"{passage} {long}"), (2, f"{long[:700_000]} {passage}"), (3, "same " * 20_000)]
    got = duplicate_spans(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)).collect()
    text = {i: t.split() for i, t in rows}
    assert all(text[r["doc_id"]][r["factor_start"] : r["factor_end"]] == text[r["ref_doc_id"]][r["ref_start"] : r["ref_start"] + r["factor_end"] - r["factor_start"]] for r in got)
    n = len(text[2])
    assert sum(r["factor_end"] - r["factor_start"] for r in got if r["doc_id"] == 2) >= n - 1
    assert {(r["span_start"], r["span_end"]) for r in got if r["doc_id"] == 3} == {(1, 20_000)}


def test_cut():
    assert cut("a b  c\nd", [(1, 3)]) == "a d" and cut("a b", [(0, 2)]) == "" and cut("é ü x", [(0, 1), (2, 3)]) == "ü"


def test_drop(spark):
    rows = corpus(random.Random(6))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    gone = brute(rows)
    kept = {r["doc_id"]: r for r in drop_duplicate_spans(docs).collect()}
    for i, t in rows:
        left = [w for k, w in enumerate(t.split()) if k not in gone.get(i, ())]
        if left:
            assert kept[i]["text"].split() == left and kept[i]["n_chars"] == len(kept[i]["text"])
            assert i in gone or kept[i]["text"] == t
        else:
            assert i not in kept or t.split() == []


def test_edges(nasty, empty):
    got = duplicate_spans(nasty).collect()
    assert {(r["doc_id"], r["span_start"], r["span_end"]) for r in got} == {(2, 0, 80), (3, 0, 80), (9, 1, 400)}
    out = drop_duplicate_spans(nasty)
    assert out.columns == nasty.columns
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12]
    assert next(r["text"] for r in rows if r["doc_id"] == 3) == "once" and next(r["text"] for r in rows if r["doc_id"] == 9) == "word"
    assert duplicate_spans(empty).count() == 0 and drop_duplicate_spans(empty).count() == 0
