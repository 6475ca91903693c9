"""Vectorised text primitives shared by the training-data operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, a
bounded slice at a time, so that no Python object is made per character or
per token.  A *word* is a maximal run of bytes that are not ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x = x * _M2
    x ^= x >> _S33
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _M3)
_POWERS = np.ones(64, dtype=np.uint64)
np.multiply.accumulate(np.full(63, 0x5851F42D4C957F2D, dtype=np.uint64), out=_POWERS[1:])


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        size = 1 << int(n).bit_length()
        more = np.ones(size, dtype=np.uint64)
        np.multiply.accumulate(np.full(size - 1, 0x5851F42D4C957F2D, dtype=np.uint64), out=more[1:])
        _POWERS = more
    return _POWERS


@dataclass
class Words:
    """Words of a slice of documents, in order.

    ``hash`` one 64-bit value a word; ``first`` the index of each document's
    first word, with the total at the end; ``start`` and ``end`` byte offsets
    inside the word's own document.
    """

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (a null is an empty text)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def words(col: pa.Array, lower: bool = True) -> Words:
    """Hash every word of every text of a slice."""
    if lower:
        col = pc.utf8_lower(col)
    raw, at = utf8(col)
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), z, z)
    inside = ~_SEP[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    if len(starts) == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), z, z)
    lens = ends - starts
    where = np.flatnonzero(inside)
    heads = np.cumsum(lens) - lens
    place = np.arange(len(where)) - np.repeat(heads, lens)
    value = _BYTE[raw[where]] * _powers(int(lens.max()) + 1)[place]
    h = mix64(np.add.reduceat(value, heads) + lens.astype(np.uint64) * _M3)
    first = np.searchsorted(starts, at)
    base = np.repeat(at[:-1], np.diff(first))
    return Words(h, first, starts - base, ends - base)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-sensitive hashes of every run of ``k`` words; runs never leave a document.

    Returns the hashes and the index of each run's first word.
    """
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = np.uint64(0x5851F42D4C957F2D)
    # h[i] = sum of word[i+j] * factor**(k-1-j): by doubling, log2(k) passes
    have, size, done, covered = w.hash, 1, None, 0
    power = [factor]
    while True:
        if k & size:
            if done is None:
                done, covered = have, size
            else:
                m = n - covered - size + 1
                done = done[:m] * np.uint64(pow(0x5851F42D4C957F2D, size, 1 << 64)) + have[covered : covered + m]
                covered += size
        if covered == k:
            break
        m = n - 2 * size + 1
        have = have[:m] * np.uint64(pow(0x5851F42D4C957F2D, size, 1 << 64)) + have[size : size + m]
        size *= 2
    left = np.repeat(w.first[1:], w.count)[: len(done)] - np.arange(len(done))
    at = np.flatnonzero(left >= k)
    return mix64(done[at]), at


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` neighbours (``len(x) - width + 1`` values)."""
    have, size, out, covered = x, 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, covered = have, size
            else:
                m = len(x) - covered - size + 1
                out = np.minimum(out[:m], have[covered : covered + m])
                covered += size
        if covered == width:
            return out
        m = len(x) - 2 * size + 1
        have = np.minimum(have[:m], have[size : size + m])
        size *= 2
