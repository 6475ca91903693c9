"""Vector functions as Column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import tokenize

DIMENSION = 128
#: Words that are embedded at a time.
SLICE = 200_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without direction."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def unit_cosine(a: Column, a_norm: Column, b: Column, b_norm: Column) -> Column:
    """Cosine with norms computed once a row instead of once a pair."""
    n = a_norm * b_norm
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def hash_embed(text: Column, dimension: int = DIMENSION) -> Column:
    """Unit vector of token counts, a token's place being its md5 modulo ``dimension``; all zeros without tokens.

    Splitting stays in the JVM. The counting is an Arrow-batched UDF: array
    functions would pass over the tokens once for each of the places.
    """
    if dimension not in (2, 4, 8, 16, 32, 64, 128, 256):
        raise ValueError("dimension must be a power of two up to 256")

    @F.arrow_udf("array<double>")
    def embed(tokens: pa.Array) -> pa.Array:
        if isinstance(tokens, pa.ChunkedArray):
            tokens = tokens.combine_chunks()
        size = tokens.value_lengths().fill_null(0).to_numpy()
        # about SLICE words at a time, whose places and counts are what stands in memory
        part = (np.cumsum(size) - size) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(tokens)]
        return pa.concat_arrays([one(tokens.slice(a, b - a), size[a:b]) for a, b in zip(cuts, cuts[1:])])

    def one(tokens: pa.Array, size: np.ndarray) -> pa.Array:
        n = len(tokens)
        words = tokens.flatten().dictionary_encode()
        place = np.array([hashlib.md5(t.encode("utf-8")).digest()[-1] % dimension for t in words.dictionary.to_pylist()], dtype=np.int64)
        cell = np.repeat(np.arange(n), size) * dimension + place[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        counts = np.bincount(cell, minlength=n * dimension).reshape(n, dimension).astype(float)
        unit = counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-300)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dimension), pa.array(unit.ravel()))

    return embed(tokenize(text))


def buckets(vector: Column, tables: int, bits: int) -> Column:
    """array<long>: the bucket of the vector in each table, by the sides of ``bits`` random hyperplanes; one matrix product a batch.

    Null vectors and those without a direction have no bucket.
    """

    @F.arrow_udf("array<long>")
    def run(vectors: pa.Array) -> pa.Array:
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        size = vectors.value_lengths().fill_null(0).to_numpy()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
        at = np.append(0, np.cumsum(size))
        rows: list[np.ndarray | None] = [None] * len(size)
        for d in np.unique(size[size > 0]).tolist():
            planes = np.random.default_rng(d).normal(size=(d, tables * bits))
            own = np.flatnonzero(size == d)
            x = flat[at[own][:, None] + np.arange(d)]
            code = ((x @ planes > 0).reshape(len(own), tables, bits) << np.arange(bits)).sum(axis=2) + (np.arange(tables) << 48)
            for i, c, ok in zip(own.tolist(), code, (x != 0).any(axis=1) & ~np.isnan(x).any(axis=1)):
                rows[i] = c if ok else None
        return pa.array([r.tolist() if r is not None else [] for r in rows], pa.list_(pa.int64()))

    return run(vector)


def embed_distinct(rows: DataFrame, embed: Callable[[Column], Column], text: str = "text", vector: str = "vector") -> DataFrame:
    """``rows`` with the vector of each text, which is embedded once however often it occurs.

    The cache of a set-oriented engine: distinct texts, embedded, joined back. A null
    text has a null vector.
    """
    once = rows.select(F.col(text).alias("__t")).filter("__t is not null").distinct().select("__t", embed(F.col("__t")).alias(vector))
    return rows.join(once, F.col(text) == F.col("__t"), "left").drop("__t")


def mock_embed(text: Column, dimension: int = DIMENSION) -> Column:
    """A fixed vector for tests: every component 0.1 for any text but null."""
    return F.when(text.isNotNull(), F.array_repeat(F.lit(0.1), dimension))
