"""Exact nearest vectors of many queries at once: pairs are scored by matrix products in tiles, and never leave them but for each query's best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.plans.session import checkpointed, small_side

#: Rows of either side of a tile, and queries and entries that are scored at a time within it.
TILE, ROWS, FIRST, MOST = 8192, 512, 256, 4096


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, squared norms, sizes) of vectors; shorter ones are filled up with zeros, those with nulls are all zeros."""
    vectors = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(size.max(initial=0))
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), width))
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    if values.null_count:
        out[row[values.is_null().to_numpy(zero_copy_only=False)]] = 0.0
    # summed one by one, as SQL does
    squares = np.zeros(len(size))
    for x in out.T:
        squares += x * x
    return out, squares, size


def _best(a: tuple, b: tuple, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of the ``k`` best of each row of a; each side is (vectors, squared norms, sizes, codes) and b is in order of its codes."""
    (av, aq, asz, ac), (bv, bq, bsz, bc) = a, b
    width = max(av.shape[1], bv.shape[1])
    av, bv = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) if v.shape[1] < width else v for v in (av, bv))
    with np.errstate(invalid="ignore"):
        au, bu = av / np.sqrt(aq)[:, None], bv / np.sqrt(bq)[:, None]
    mixed = len(np.unique(np.append(asz, bsz))) > 1
    found = []
    for start in range(0, len(au), ROWS):
        u = au[start : start + ROWS]
        row, col, key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        cut = np.full(len(u), least - 1e-9)
        at, step = 0, FIRST
        while at < len(bu):
            s = u @ bu[at : at + step].T
            if mixed:
                s[asz[start : start + ROWS, None] != bsz[None, at : at + step]] = 0.0
            r, c = np.nonzero(~(s < cut[:, None]))  # not a number goes first, as in SQL
            v = np.rint(s[r, c] * 1e9)
            ok = ac[start + r] != bc[at + c]
            r, c, v = r[ok], c[ok] + at, np.where(np.isnan(v), np.inf, v)[ok]
            row, col, key = np.append(row, r), np.append(col, c), np.append(key, v)
            order = np.lexsort((col, -key, row))
            row, col, key = row[order], col[order], key[order]
            first = np.searchsorted(row, np.arange(len(u)))
            kept = np.arange(len(row)) - first[row] < k
            row, col, key = row[kept], col[kept], key[kept]
            full = np.bincount(row, minlength=len(u)) == k
            last = np.searchsorted(row, np.arange(len(u)), side="right") - 1
            # later entries have larger ids: only a better score takes a place
            cut[full] = np.maximum(cut[full], (key[last[full]] + 0.5) / 1e9 - 1e-15)
            at, step = at + step, min(2 * step, MOST)
        found.append((row + start, col))
    row, col = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    dot = np.zeros(len(row))
    for x, y in zip(av.T, bv.T):  # one by one again
        dot += x[row] * y[col]
    with np.errstate(invalid="ignore"):
        score = np.clip(np.where(asz[row] == bsz[col], dot / np.sqrt(aq[row] * bq[col]), 0.0), -1.0, 1.0)
        score = np.trunc(score * 1e9 + np.copysign(0.5, score)) / 1e9
    ok = ~(score < least)
    return row[ok], col[ok], score[ok]


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of the values of both columns."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks()
    _, code = np.unique(both.to_numpy(zero_copy_only=False), return_inverse=True)
    return code[: len(a)], code[len(a) :]


def best_in_tiles(queries: DataFrame, entries: DataFrame, k: int, least: float, by: str | None = None, same: bool = False) -> DataFrame:
    """(query_id, id, score): of each tile the ``k`` best entries (id, vector[, by]) of each query (query_id, query_vector[, by]), among them the ``k`` best of all.

    The cosine is exact, rounded to nine places, at least ``least``; equal scores go by
    id. Vectors of another size than the query's have 0, those without a direction no
    score. With ``by`` only entries of the query's value meet it; unless ``same``, an
    entry of the query's own id doesn't. Values of ``by`` with many rows are cut into
    tiles of about 8,192 by 8,192 rows by hash of the id, small ones share a task.
    Work is quadratic in the rows of a value, memory bounded; what is shuffled is
    each row once for a tile of the other side.
    """
    g = F.col(by) if by else F.lit(0)
    q = queries.select("query_id", "query_vector", g.alias("__g")).filter("query_id is not null and query_vector is not null and __g is not null")
    e = entries.select("id", "vector", g.alias("__g")).filter("id is not null and vector is not null and __g is not null")
    n = lambda d, name: d.groupBy("__g").agg(F.count("*").alias(name))
    parts = lambda name: F.ceil(F.col(name) / TILE).cast("int")
    sizes = checkpointed(n(q, "nq").join(n(e, "ne"), "__g").select("__g", parts("nq").alias("pq"), parts("ne").alias("pe"), (F.col("nq") + F.col("ne")).alias("n")))
    small = (F.col("pq") == 1) & (F.col("pe") == 1)
    packs = (sizes.filter(small).agg(F.sum("n")).first()[0] or 0) // TILE + 1
    h = F.xxhash64("__g")
    cuts = small_side(sizes.select("__g", "pq", "pe", F.when(small, F.pmod(h, F.lit(packs))).otherwise(h).alias("__t"), (~small).alias("__cut")))

    def cells(d: DataFrame, ident: str, own: str, other: str, mine: str, yours: str) -> DataFrame:
        place = F.when(F.col("__cut"), F.pmod(F.xxhash64(ident), F.col(own)).cast("int")).otherwise(-1)
        across = F.when(F.col("__cut"), F.sequence(F.lit(0), F.col(other) - 1)).otherwise(F.array(F.lit(-1)))
        return d.join(cuts, "__g").select(*d.columns, F.col("__t").alias("__t"), place.alias(mine), F.explode(across).alias(yours))

    keys = ["__t", "__i", "__j"]
    left = cells(q, "query_id", "pq", "pe", "__i", "__j").groupBy(*keys)
    right = cells(e, "id", "pe", "pq", "__j", "__i").groupBy(*keys)
    kinds = dict(q.dtypes) | dict(e.dtypes)

    def tile(x: pa.Table, y: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        types = [x.schema.field("query_id").type, y.schema.field("id").type, pa.float64()]
        rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(x) and len(y):
            xg, yg = _codes(x["__g"], y["__g"])
            xc, yc = (np.full(len(x), -1), _codes(y["id"], y["id"])[0]) if same else _codes(x["query_id"], y["id"])
            a, b = (*_matrix(x["query_vector"]), xc), (*_matrix(y["vector"]), yc)
            # in order of value and id, without vectors that have no direction
            xo, yo = np.lexsort((xc, xg)), np.lexsort((yc, yg))
            xo, yo = xo[~(a[1][xo] <= 0)], yo[~(b[1][yo] <= 0)]
            for v in np.intersect1d(xg[xo], yg[yo]).tolist():
                xi, yi = (o[np.searchsorted(c[o], v) : np.searchsorted(c[o], v, side="right")] for o, c in ((xo, xg), (yo, yg)))
                r, c, s = _best(tuple(z[xi] for z in a), tuple(z[yi] for z in b), k, least)
                rows.append(xi[r]), cols.append(yi[c]), scores.append(s)
        r, c = np.concatenate(rows), np.concatenate(cols)
        pick = lambda t, name, i: t[name].combine_chunks().take(pa.array(i))
        return pa.table([pick(x, "query_id", r).cast(types[0]), pick(y, "id", c).cast(types[1]), pa.array(np.concatenate(scores))], names=names)

    return left.cogroup(right).applyInArrow(tile, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
