"""Near-duplicate documents: 256-bit SimHash, compared exactly, tile against tile.

The fingerprint of a document is the sign of the sum of its features' hash bits;
features are its distinct words and distinct pairs of neighbouring words (words
alone would take two texts of one small vocabulary for copies). Two documents
are near duplicates when their fingerprints differ in at most ``radius`` bits,
whatever their sizes. 54 of 256 bits is a cosine of 0.79 between the feature
sets: about six words changed in a hundred, one by one, or more in a row.

Documents of equal fingerprint are folded first. The distinct fingerprints are
laid out in tiles in order of population count. Tile pairs whose population
counts are further apart than the radius are never formed. Small tiles are
compared whole by numpy exclusive-or and bit counts in blocks, which are skipped
by the same rule. Large ones are compared part by part: the bits are cut into m
parts with a radius each, and since the parts' radii plus one add up to the
radius plus one, a pair that is further apart than its radius in every part is
further apart than the radius in all. So only the rows whose keys of a part are
within that part's radius meet, and no pair within the radius is lost. Every
tile pair hands on a spanning forest of its hits, not all of them, so a group of
thousands costs thousands of edges. Comparing stays quadratic in the number of
distinct fingerprints, over a share of the pairs (``parts``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.arrow_text import mix64, shingles, slices, words
from recollect.llm.common import checkpointed, need, table
from recollect.llm.components import components

BITS = 256
RADIUS = 54
#: Rows of a tile: two, with what comparing them takes, fit a Python worker of a few hundred MB.
TILE_ROWS = 3 << 18
#: Tile pairs are cut by parts into so many tasks, or as many parts as there are.
TASKS = 96
BLOCK_ROWS = 512
#: Widest key of a part, in bits, and the seconds that a key, a row met by a key, and a pair of rows take about (for the choice of the parts alone).
KEY_BITS, KEY_S, ROW_S, PAIR_S = 20, 3e-5, 1.5e-8, 4e-9
#: Pairs of rows compared at a time, of how many rows at most on the longer side, and hits held before they are folded to a forest.
PAIRS_AT_ONCE, ROWS_AT_ONCE, HITS_AT_ONCE = 1 << 16, 4096, 1 << 22

_LANES = np.array([int.from_bytes(bytes((b >> i) & 1 for i in range(8)), "little") for b in range(256)], dtype=np.uint64)
_SEEDS = mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprints(features: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Four uint64 a document from its distinct feature hashes; ``heads``: where each document's begin. No document may be empty."""
    n = np.diff(np.append(heads, len(features)))
    # lanes of eight bits overflow after 255 features: sum in parts, then add up the parts
    parts = (n + 254) // 255
    first = np.cumsum(parts) - parts
    start = np.repeat(heads, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * 255
    out = np.empty((len(heads), 4), dtype=np.uint64)
    for w in range(4):
        lanes = _LANES[mix64(features ^ _SEEDS[w]).view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, start, axis=0).view(np.uint8).reshape(len(start), 64)
        total = np.add.reduceat(sums.astype(np.int32), first, axis=0)
        out[:, w] = np.packbits(total * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def distinct_features(col: pa.Array, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, 44 bits wide, of each document's distinct words and (with ``pairs``) word pairs, and how many each has."""
    w = words(col)
    if len(w.hash) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(col), np.int64)
    doc = w.doc.astype(np.uint64) << np.uint64(44)
    key = doc | (w.hash >> np.uint64(20))
    if pairs:
        h, at = shingles(w, 2)
        key = np.concatenate([key, doc[at] | (h >> np.uint64(20))])
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    return key & np.uint64((1 << 44) - 1), np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=len(col))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n features, f0..f3) of every document that has a word and a ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                features, n = distinct_features(batch.column(1))
                has = np.flatnonzero(n)
                if len(has) == 0:
                    continue
                f = fingerprints(features, (np.cumsum(n) - n)[has]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)).cast(pa.int64()), pa.array(n[has]), *[pa.array(np.ascontiguousarray(f[:, i])) for i in range(4)]], ["doc_id", "n", "f0", "f1", "f2", "f3"])

    return need(docs, "doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, n long, f0 long, f1 long, f2 long, f3 long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def compare(fa: np.ndarray, fb: np.ndarray, radius: int = RADIUS, same: bool = False, block: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs (i of a, j of b) within the radius; ``same``: a is b, pairs once.

    ``fa``, ``fb``: n x 4 uint64. Blocks in order of population count are skipped
    where no two counts are within the radius.
    """
    if len(fa) == 0 or len(fb) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pa_, pb_ = (np.bitwise_count(f).sum(axis=1).astype(np.int64) for f in (fa, fb))
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb_, kind="stable")
    fa, pa_, fb, pb_ = fa[oa], pa_[oa], fb[ob], pb_[ob]
    a_, b_ = ([np.ascontiguousarray(f[:, i]) for i in range(3)] for f in (fa, fb))
    bits = np.empty((block, block), dtype=np.uint64)
    counts = [np.empty((block, block), dtype=np.uint8) for _ in range(2)]
    out_i, out_j = [], []
    for s in range(0, len(fa), block):
        e = min(s + block, len(fa))
        x = [v[s:e, None] for v in a_]
        lo, hi = np.searchsorted(pb_, [pa_[s] - radius, pa_[e - 1] + radius + 1])
        for t in range(max(lo, s) if same else lo, hi, block):
            u = min(t + block, hi)
            # three of the four words are enough to rule nearly all pairs out
            w, d, c = bits[: e - s, : u - t], counts[0][: e - s, : u - t], counts[1][: e - s, : u - t]
            np.bitwise_count(np.bitwise_xor(x[0], b_[0][None, t:u], out=w), out=d)
            for k in (1, 2):
                np.bitwise_count(np.bitwise_xor(x[k], b_[k][None, t:u], out=w), out=c)
                np.add(d, c, out=d)
            if d.min() > radius:
                continue
            i, j = np.nonzero(d <= radius)
            i, j = i + s, j + t
            if same:
                later = i < j
                i, j = i[later], j[later]
            near = np.bitwise_count(fa[i] ^ fb[j]).sum(axis=1) <= radius
            out_i.append(oa[i[near]])
            out_j.append(ob[j[near]])
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


@cache
def parts(n: int, radius: int = RADIUS) -> tuple[tuple[int, int, int], ...]:
    """(first bit, bits, radius) of the parts by which ``n`` rows are compared with as many; none: compare them whole.

    Wherever two fingerprints are within ``radius``, they are within the part's
    radius in one of the parts at least: all parts' radii plus one add up to ``radius`` + 1
    (at small radii few parts are needed, and bits beyond them are in none).
    """
    best, least = (), PAIR_S * n * n / 2
    for m in range(1, min(BITS, radius + 1) + 1):
        low, more = divmod(radius + 1, m)
        radii = [low] * more + [low - 1] * (m - more)
        ball = [[sum(math.comb(w, k) for k in range(r + 1)) for w in range(BITS + 1)] for r in (low, low - 1)]
        ball = [ball[0]] * more + [ball[1]] * (m - more)
        # every bit goes to the part that most pairs meet in
        width = [1] * m
        for _ in range(min(BITS, KEY_BITS * m) - m):
            p = max((p for p in range(m) if width[p] < KEY_BITS), key=lambda p: (ball[p][width[p]] / 2 ** width[p], -width[p]))
            width[p] += 1
        cost = 0.0
        for p in range(m):
            keys, share = min(2 ** width[p], n), ball[p][width[p]] / 2 ** width[p]
            cost += KEY_S * keys + share * n / 2 * (ROW_S * keys + PAIR_S * n)
        if cost < least:
            first = [sum(width[:p]) for p in range(m)]
            best, least = tuple(zip(first, width, radii)), cost
    return best


def _keys(f: np.ndarray, first: int, width: int) -> np.ndarray:
    k, s = divmod(first, 64)
    key = f[:, k] >> np.uint64(s)
    if s + width > 64:
        key |= f[:, k + 1] << np.uint64(64 - s)
    return (key & np.uint64((1 << width) - 1)).astype(np.int64)


def candidates(fa: np.ndarray, fb: np.ndarray, part: tuple[int, int, int], same: bool = False) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows whose keys of ``part`` are within its radius, all of one key of a at a time.

    Yields (rows of a, rows of b, order of a, order of b); rows are places in the
    orders. ``same``: a is b, and a pair is met once (and rows with themselves and later ones, both ways).
    """
    first, width, near = part
    ka = _keys(fa, first, width)
    oa = np.argsort(ka, kind="stable")
    at_a = np.append(0, np.cumsum(np.bincount(ka, minlength=1 << width)))
    if same:
        ob, at_b = oa, at_a
    else:
        kb = _keys(fb, first, width)
        ob, at_b = np.argsort(kb, kind="stable"), np.append(0, np.cumsum(np.bincount(kb, minlength=1 << width)))
    flips = np.arange(1 << width)
    flips = flips[np.bitwise_count(flips) <= near]
    every = np.arange(len(fb))
    for u in np.flatnonzero(np.diff(at_a)).tolist():
        v = flips ^ u
        if same:
            v = v[v >= u]
        s = at_b[v]
        n = at_b[v + 1] - s
        end = np.cumsum(n)
        if end[-1]:
            yield slice(int(at_a[u]), int(at_a[u + 1])), np.repeat(s - end + n, n) + every[: end[-1]], oa, ob


def compare_part(fa: np.ndarray, fb: np.ndarray, part: tuple[int, int, int], radius: int = RADIUS, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The index pairs (i of a, j of b) within the radius that are within the radius of ``part`` in its bits; ``same``: a is b, pairs once."""
    if len(fa) == 0 or len(fb) == 0:
        return
    # three of the four words are enough to rule nearly all pairs out: those that the part isn't in
    use = [k for k in range(4) if k != part[0] // 64]
    a_ = b_ = None
    w = np.empty(PAIRS_AT_ONCE, dtype=np.uint64)
    d, c = np.empty((2, PAIRS_AT_ONCE), dtype=np.uint8)
    for at, met, oa, ob in candidates(fa, fb, part, same):
        if a_ is None:
            a_ = [fa[oa, k] for k in use]
            b_ = a_ if same else [fb[ob, k] for k in use]
        for t in range(0, len(met), ROWS_AT_ONCE):
            rows = met[t : t + ROWS_AT_ONCE]
            y = [v.take(rows) for v in b_]
            step = PAIRS_AT_ONCE // len(rows)
            for s in range(at.start, at.stop, step):
                e = min(s + step, at.stop)
                shape = e - s, len(rows)
                wn, dn, cn = (v[: shape[0] * shape[1]].reshape(shape) for v in (w, d, c))
                np.bitwise_count(np.bitwise_xor(a_[0][s:e, None], y[0], out=wn), out=dn)
                for k in (1, 2):
                    np.bitwise_count(np.bitwise_xor(a_[k][s:e, None], y[k], out=wn), out=cn)
                    np.add(dn, cn, out=dn)
                if dn.min() > radius:
                    continue
                i, j = np.nonzero(dn <= radius)
                i, j = i + s, rows[j]
                if same:
                    later = i < j
                    i, j = i[later], j[later]
                i, j = oa[i], ob[j]
                near = np.bitwise_count(fa[i] ^ fb[j]).sum(axis=1) <= radius
                if near.any():
                    yield i[near], j[near]


def _forest(n: int, hits: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of ``n`` over the hits, which are folded as they come."""
    held, size = [], 0
    for i, j in hits:
        held.append((i, j))
        size += len(i)
        if size > HITS_AT_ONCE:
            root = _roots(n, *(np.concatenate(x) for x in zip(*held)))
            moved = np.flatnonzero(root != np.arange(n))
            held, size = [(moved, root[moved])], 0
    return _roots(n, *(np.concatenate(x) for x in zip(*held))) if held else np.arange(n)


def near_edges(prints: DataFrame, radius: int = RADIUS, tile_rows: int | None = None) -> DataFrame:
    """Edges (src > dst) that connect exactly the near duplicates among distinct fingerprints (id, f0..f3).

    A tile pair is compared by ``parts``, which are dealt to as many tasks as
    make use of a cluster while there are few tile pairs.
    """
    count = prints.count()
    # tiles of nearly equal size: a last one of a few rows would be compared like a full one
    tile_rows = tile_rows or math.ceil(max(count, 1) / math.ceil(max(count, 1) / TILE_ROWS))
    n_tiles = math.ceil(max(count, 1) / tile_rows)
    by = parts(min(tile_rows, max(count, 1)), radius)
    tasks = min(max(len(by), 1), math.ceil(TASKS * 2 / (n_tiles * (n_tiles + 1))))
    pop = sum((F.bit_count(F.col(f"f{i}")) for i in range(1, 4)), F.bit_count("f0"))
    rows = prints.withColumn("pop", pop)
    # Rows in order of population count, cut every tile_rows: a cell's rows are spread over its stretch by hash.
    cell = rows.groupBy("pop").agg(F.count("*").alias("c"))
    # cells are at most 257, whatever the rows: the window's one partition and the broadcast are of bounded size
    cell = cell.withColumn("s", F.coalesce(F.sum("c").over(Window.orderBy("pop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(F.broadcast(cell), "pop").withColumn("tile", F.floor((F.col("s") + F.pmod(F.xxhash64("f0", "f1", "f2", "f3"), F.col("c"))) / F.lit(tile_rows)))
    tiles = rows.groupBy("tile").agg(F.min("pop").alias("lo"), F.max("pop").alias("hi"))
    left = tiles.select(F.col("tile").alias("lt"), F.col("lo").alias("ll"), F.col("hi").alias("lh"))
    right = tiles.select(F.col("tile").alias("rt"), F.col("lo").alias("rl"), F.col("hi").alias("rh"))
    pairs = left.join(right, (F.col("lt") <= F.col("rt")) & (F.col("rl") - F.col("lh") <= radius) & (F.col("ll") - F.col("rh") <= radius)).select("lt", "rt")
    pairs = pairs.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    sides = pairs.select("*", F.col("lt").alias("tile"), F.lit(0).alias("side")).unionByName(pairs.filter("lt <> rt").select("*", F.col("rt").alias("tile"), F.lit(1).alias("side")))
    placed = rows.select("tile", "id", "f0", "f1", "f2", "f3").join(sides, "tile").drop("tile")

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        side = part["side"].to_numpy()
        ids = part["id"].to_numpy()
        f = np.stack([part[f"f{i}"].to_numpy().view(np.uint64) for i in range(4)], axis=1)
        same = key[0].as_py() == key[1].as_py()
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        fa = f[a]
        fb = fa if same else f[b]
        ra, rb = rank[a], rank[b]
        del f, side, part
        if by:
            hits = (x for p in by[key[2].as_py() :: tasks] for x in compare_part(fa, fb, p, radius, same))
        else:
            hits = iter([compare(fa, fb, radius, same)])
        root = _forest(len(ids), ((ra[i], rb[j]) for i, j in hits))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"src": ids[order[moved]], "dst": ids[order[root[moved]]]})

    return placed.groupBy("lt", "rt", "task").applyInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile_rows: int | None = None) -> DataFrame:
    """Documents that copy another: (doc_id, kept_doc_id, group_size), a row for each ``doc_id`` that goes.

    Groups are the connected components of the near-duplicate relation; the
    smallest ``doc_id`` of each stays and is ``kept_doc_id``. ``group_size``
    counts the group's distinct ids.

    Rows that share a ``doc_id`` are one document (its texts join their groups).
    A null ``doc_id``, a null text and a text without words are never grouped.
    Texts of any length are read whole. Other columns are ignored. No rows in,
    no rows out.
    """
    prints = checkpointed(fingerprint_table(docs))
    f = ["f0", "f1", "f2", "f3"]
    folded = checkpointed(prints.groupBy(*f).agg(F.min("doc_id").alias("id"), F.collect_set("doc_id").alias("ids")))
    # one id may stand for several fingerprints: equal rows of `nodes` stay apart in the comparison, equal ids meet in the components
    near = near_edges(folded.select("id", *f), radius, tile_rows)
    equal = folded.filter(F.size("ids") > 1).select(F.explode("ids").alias("src"), F.col("id").alias("dst")).filter("src != dst")
    groups = components(near.filter("src != dst").unionByName(equal))
    size = groups.groupBy("root").agg((F.count("*") + 1).alias("group_size"))
    return groups.join(size, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"), "group_size")


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the near duplicates of others, all columns as they were.

    Of rows that share a ``doc_id`` and stay, one is kept (the first by text).
    Rows without a ``doc_id`` stay.
    """
    gone = near_duplicates(docs, **parameters).select(F.col("doc_id").alias("__rc_id"), F.lit(True).alias("__rc_gone"))
    twice = need(docs, "doc_id").filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__rc_id"), F.lit(False).alias("__rc_gone"))
    marks = gone.unionByName(twice).groupBy("__rc_id").agg(F.max("__rc_gone").alias("__rc_gone"))
    # the join leaves rows of an id in one partition, and the window needs no more: the texts are shuffled once.
    # Rows without an id are spread by their text within it
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    order = Window.partitionBy("doc_id", spread).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in ["text", *[k for k, t in docs.dtypes if k != "text" and not t.startswith("map")]]])
    left = docs.join(marks, docs["doc_id"] == marks["__rc_id"], "left").filter("not coalesce(__rc_gone, false)")
    return left.withColumn("__rc_nr", F.row_number().over(order)).filter("__rc_gone is null or __rc_nr = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
