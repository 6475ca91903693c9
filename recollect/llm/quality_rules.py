"""Quality rules by compression bands.

zstandard's ratio (bytes in / bytes out) of a whole document and of its fixed
chunks tells repetitive text (compresses far too well) and noise (hardly
compresses) from prose. Ratios rise with length, since the compressor learns
as it goes, so each length has its own limits: a text's for the whole, and for
each chunk those of the chunk's length (the last one is what is left over).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from recollect.llm.arrow_text import slices
from recollect.llm.common import need


@dataclass(frozen=True)
class Band:
    """Limits for texts and chunks of at least ``from_bytes`` bytes, up to the next band."""

    from_bytes: int
    lowest: float
    highest: float


#: Prose compresses about 1.5 times at 500 bytes, 2.2 at 8 KB, 2.7 at 100 KB. Base64 gives 1.3, other noise less.
BANDS = (
    Band(0, 0.0, 4.0),
    Band(128, 0.95, 2.7),
    Band(512, 1.25, 3.0),
    Band(2048, 1.4, 3.4),
    Band(8192, 1.45, 4.0),
    Band(32768, 1.5, 4.8),
)
CHUNK_BYTES = 2048
#: Most of a text's bytes that may lie in chunks outside their limits.
BAD_SHARE = 0.3
LEVEL = 3

RESULT = "doc_id long, n_bytes long, ratio double, n_chunks int, lowest_chunk double, highest_chunk double, bad_share double, reason string, keep boolean"
_NAMES = ["n_bytes", "ratio", "n_chunks", "lowest_chunk", "highest_chunk", "bad_share", "reason", "keep"]
_KINDS = [pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]


def measure(text: str | None, compressor, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE) -> tuple:
    """(n_bytes, ratio, n_chunks, lowest_chunk, highest_chunk, bad_share, reason, keep) of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not raw.strip():
        return n, None, 0, None, None, None, "empty", False
    starts = [b.from_bytes for b in bands]
    ratio = n / len(compressor.compress(raw))
    band = bands[bisect_right(starts, n) - 1]
    low = high = ratio  # a text of one chunk is that chunk
    bad = 0 if band.lowest <= ratio <= band.highest else n
    if n > chunk_bytes:
        low, high, bad = float("inf"), 0.0, 0
        for at in range(0, n, chunk_bytes):
            chunk = raw[at : at + chunk_bytes]
            r = len(chunk) / len(compressor.compress(chunk))
            own = bands[bisect_right(starts, len(chunk)) - 1]
            if not own.lowest <= r <= own.highest:
                bad += len(chunk)
            low, high = min(low, r), max(high, r)
    share = bad / n
    if ratio > band.highest:
        reason = "repetitive"
    elif ratio < band.lowest:
        reason = "incompressible"
    elif share > bad_share:
        reason = "chunks"
    else:
        reason = None
    return n, ratio, -(-n // chunk_bytes), low, high, share, reason, reason is None


def _zstd(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, write_content_size=True)


def compression_bands(docs: DataFrame, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE, level: int = LEVEL) -> DataFrame:
    """Measure every document and say whether it stays; one row a row of ``docs``.

    ``keep`` is false with ``reason`` *repetitive* or *incompressible* (the ratio
    of the whole text is outside its length's band), *chunks* (more than
    ``bad_share`` of its bytes lie in chunks outside the bands of their own
    lengths), or *empty*.

    Null and blank texts are *empty*, with 0 chunks. A text of up to
    ``chunk_bytes`` is one chunk. A null ``doc_id`` is carried along. Repeated rows
    are judged one by one, alike. Very long texts are read whole. Other columns
    are ignored. No rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _zstd(level)
        for whole in batches:
            for batch in slices(whole, "text"):
                cols = zip(*[measure(t.as_py(), z, bands, chunk_bytes, bad_share) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, _KINDS)]], ["doc_id", *_NAMES])

    return need(docs, "doc_id", "text").mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES, bad_share: float = BAD_SHARE, level: int = LEVEL) -> DataFrame:
    """The rows of ``docs`` that the compression bands keep, with all their columns, whatever those are called.

    The verdict is computed beside the row, so nothing is joined or shuffled. Null
    and blank texts go; a null ``doc_id`` and repeated rows are judged by their
    text like any other. An empty table stays empty.
    """
    names = list(docs.columns)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _zstd(level)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.filter(pa.array([measure(t.as_py(), z, bands, chunk_bytes, bad_share)[-1] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return compression_bands(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["BANDS", "Band", "compression_bands", "keep_good", "measure", "query"]
