import random

import numpy as np
import pyarrow as pa

from recollect.llm.simhash import candidates, compare, compare_part, distinct_features, drop_near_duplicates, fingerprints, near_duplicates, parts

from .conftest import DOCS, prose


def brute_groups(prints, ids, radius=54):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            d = sum(int(x).bit_count() for x in prints[i] ^ prints[j])
            if d <= radius:
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids if find(i) != i}


def corpus(rng, n=60):
    base = [prose(rng, rng.randint(3, 400)) for _ in range(n)]
    out = list(base)
    for t in base[::3]:
        w = t.split()
        for share in (0.0, 0.02, 0.05, 0.3):
            out.append(" ".join(rng.choice(["qua", "zor", "blim"]) + x if rng.random() < share else x for x in w))
    rng.shuffle(out)
    return out


def test_fingerprint_is_the_sign_of_bit_sums():
    from recollect.llm.simhash import _SEEDS, mix64

    texts = pa.array(["a b c", "one two", "x " * 600 + " ".join(str(i) for i in range(700)), "a"])
    f, n = distinct_features(texts)
    prints = fingerprints(f, np.cumsum(n) - n)
    at = np.append(0, np.cumsum(n))
    for d in range(4):
        for w in range(4):
            h = mix64(f[at[d] : at[d + 1]] ^ _SEEDS[w])
            want = sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h) * 2 > n[d])
            assert int(prints[d, w]) == want


def test_compare_is_exact():
    rng = np.random.default_rng(3)
    f = rng.integers(0, 1 << 63, (300, 4)).astype(np.uint64)
    f[100:200] = f[:100] ^ (np.uint64(1) << rng.integers(0, 63, (100, 4)).astype(np.uint64))
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if sum(int(x).bit_count() for x in f[i] ^ f[j]) <= 100}
    i, j = compare(f, f, radius=100, same=True, block=37)
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want and want
    i, j = compare(f[:150], f[150:], radius=100, block=37)
    assert {(a, b + 150) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in want if a < 150 <= b}


def test_groups_against_brute_force(spark):
    texts = corpus(random.Random(2))
    f, n = distinct_features(pa.array(texts))
    want = brute_groups(fingerprints(f, np.cumsum(n) - n), list(range(len(texts))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    for rows in (7, 32768):
        got = near_duplicates(docs, tile_rows=rows).collect()
        assert {r["doc_id"]: r["kept_doc_id"] for r in got} == want
    kept = drop_near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i in range(len(texts)) if i not in want]


def test_edges(nasty, empty):
    got = {r["doc_id"]: (r["kept_doc_id"], r["group_size"]) for r in near_duplicates(nasty).collect()}
    assert got == {2: (1, 3), 3: (1, 3)}
    kept = drop_near_duplicates(nasty)
    assert kept.columns == nasty.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0


def test_large_group_is_one(spark):
    rng = random.Random(9)
    w = prose(rng, 120).split()
    rows = [(i, " ".join(x if rng.random() > 0.02 else "changed%d" % rng.randint(0, 9) for x in w), "en", "s", 0) for i in range(1500)]
    got = near_duplicates(spark.createDataFrame(rows, DOCS), tile_rows=500).collect()
    assert len(got) == 1499 and {r["kept_doc_id"] for r in got} == {0} and {r["group_size"] for r in got} == {1500}


def test_copies_of_another_length(spark):
    """Within the radius, but with far fewer features than the other: cut short, or with lines put round it."""
    rng = random.Random(14)
    texts = []
    for n in (150, 300, 600, 1200):
        t = prose(rng, n)
        line = " ".join("menu%d" % rng.randrange(10**6) for _ in range(n // 4))
        texts += [t, line + "\n" + t, " ".join(t.split()[: n * 7 // 10])]
    f, n = distinct_features(pa.array(texts))
    prints = fingerprints(f, np.cumsum(n) - n)
    near = {(i, j) for j in range(len(texts)) for i in range(j) if sum(int(x).bit_count() for x in prints[i] ^ prints[j]) <= 54}
    assert sum(min(n[i], n[j]) < 0.8 * max(n[i], n[j]) for i, j in near) >= 4
    want = brute_groups(prints, list(range(len(texts))))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    for rows in (3, None):
        assert {r["doc_id"]: r["kept_doc_id"] for r in near_duplicates(docs, tile_rows=rows).collect()} == want


def test_appended_text_is_near_whenever_the_radius_says_so(spark):
    """Texts with 30 % put at the end: every pair within the radius is found, and nearly all are within it."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        t = prose(rng, 200)
        texts += [t, f"{t} {prose(rng, 60)}"]
    f, n = distinct_features(pa.array(texts))
    prints = fingerprints(f, np.cumsum(n) - n)
    near = {2 * k + 1: 2 * k for k in range(60) if sum(int(x).bit_count() for x in prints[2 * k] ^ prints[2 * k + 1]) <= 54}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["kept_doc_id"] for r in near_duplicates(docs, tile_rows=16).collect()}
    assert len(near) > 50 and got == brute_groups(prints, list(range(len(texts)))) and all(got[i] == k for i, k in near.items())


def test_parts_lose_no_pair_and_meet_few():
    """Part by part as by comparing all: at the very radius, with the bits that differ spread so that few parts are near. And at a share of the pairs."""
    rng = np.random.default_rng(11)
    n = 3000
    f = rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64) * np.uint64(2)
    for radius in (54, 30, 3, 0):
        for by in {parts(1 << 20, radius), parts(100_000, radius)}:
            assert sum(r + 1 for _, _, r in by) == radius + 1 and by[-1][0] + by[-1][1] <= 256 and [s for s, _, _ in by[1:]] == [s + w for s, w, _ in by[:-1]]
            b = np.unpackbits(f.view(np.uint8), axis=1, bitorder="little")
            for i in range(0, n, 3):
                # one more than a part's radius in each part but one
                last, off = rng.integers(len(by)), []
                for k, (s, w, r) in enumerate(by):
                    off += (s + rng.permutation(w)[: r + (k != last)]).tolist()
                b[i + 1] = b[i]
                b[i + 1, off] ^= 1
                b[i + 2] = b[i + 1]
                b[i + 2, [x for x in range(256) if x not in off][0]] ^= 1
            g = np.packbits(b, axis=1, bitorder="little").view(np.uint64)
            for same, x, y in ((True, g, g), (False, g[: n // 2 + 1], g[n // 2 + 1 :])):
                want = {(min(p), max(p)) if same else p for p in zip(*(v.tolist() for v in compare(x, y, radius, same)))}
                hits = [p for part in by for i, j in compare_part(x, y, part, radius, same) for p in zip(i.tolist(), j.tolist())]
                assert {(min(p), max(p)) if same else p for p in hits} == want and (not same or len(want) >= n // 3)
    x = rng.integers(0, 1 << 63, (20_000, 4)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (20_000, 4)).astype(np.uint64)
    met = sum((at.stop - at.start) * len(rows) for part in parts(1 << 20) for at, rows, *_ in candidates(x, x, part, True))
    assert met < 0.15 * 20_000**2 / 2


def test_groups_by_parts(spark, monkeypatch):
    """The job on tiles that are compared part by part, in several tasks, gives the groups of brute force."""
    from recollect.llm import simhash

    by = parts(1 << 20)
    monkeypatch.setattr(simhash, "parts", lambda n, radius: by)
    monkeypatch.setattr(simhash, "HITS_AT_ONCE", 50)
    texts = corpus(random.Random(4))
    f, n = distinct_features(pa.array(texts))
    want = brute_groups(fingerprints(f, np.cumsum(n) - n), list(range(len(texts))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    for rows in (40, None):
        assert {r["doc_id"]: r["kept_doc_id"] for r in near_duplicates(docs, tile_rows=rows).collect()} == want
