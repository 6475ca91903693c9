"""Substring dedup: documents parsed relative to the corpus's own reference, an index of word windows.

The reference is the corpus without what it repeats: of every window of
``min_words`` words that occurs more than once, the first place, in order of
(doc_id, position). Relative to it a document is parsed into factors from left
to right. A factor begins at a window that the reference holds (and that isn't
that place itself) and goes on as long as the document's next word is the
reference's next; since the reference holds a window once, that is the longest
match. The windows across a factor's end are looked up as well: the next factor
begins with the first of them that is found, its overlap trimmed, and the two
are one duplicate span.

This differs from relative Lempel-Ziv parsing against blocks in the index: the
reference is sharded by hash of the window, not by block, and a match is found
by hash, not in a suffix array. Factors under ``min_words`` are never sought.
Documents needn't be sent to every block: a passage in many documents would
have to meet as many blocks. Two steps find the factors:

1. Anchors. Of each ``min_words`` window the smallest hash among its runs of
   ``ANCHOR_WORDS`` words is kept (winnowing), so equal windows, wherever they
   stand, keep equal anchors. An anchor that occurs once rules out every window
   that chose it; that leaves only the repeated part of the corpus.
2. Windows. The windows whose anchor repeats are grouped by their own hash, of
   128 bits (64 alone would make some windows of 100 TB equal that aren't).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.arrow_text import Words, mix64, shingles, slices, sliding_min, words
from recollect.llm.common import checkpointed, need, table, text_hash

MIN_WORDS = 50
ANCHOR_WORDS = 16
#: A word's place is kept in so many bits, beside a tag that tells texts of one doc_id apart.
PLACE_BITS = 30
_SECOND = np.uint64(0x94D049BB133111EB)


def _tag(u1):
    return F.shiftrightunsigned(u1, PLACE_BITS)


def anchors(w: Words, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``k`` words that windows of ``min_words`` choose: (hash, index of first word, document), once a place."""
    h, at = shingles(w, k)
    width = min_words - k + 1
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(w.first) - 1), np.maximum(w.count - k + 1, 0))
    place = at - w.first[doc]
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = (h & ~low) | place.astype(np.uint64)
    best = sliding_min(packed, width)
    ok = doc[: len(best)] == doc[width - 1 :]
    best, doc = best[ok], doc[: len(ok)][ok]
    new = np.append(True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]))[: len(best)]
    best, doc = best[new], doc[new]
    first = w.first[doc] + (best & low).astype(np.int64)
    # `at` is ascending: the run's hash is found by its first word
    return h[np.searchsorted(at, first)], first, doc


def windows_with(w: Words, chosen: list[np.ndarray], min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose anchor is among the document's ``chosen`` hashes: (hash, second hash, index of first word)."""
    h, at = shingles(w, min_words)
    a, first, doc = anchors(w, min_words, k)
    if len(h) == 0 or len(a) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    good = np.concatenate([np.isin(a[lo:hi], c) for lo, hi, c in zip(*(np.searchsorted(doc, np.arange(len(chosen)) + d) for d in (0, 1)), chosen)] or [np.zeros(0, bool)])
    # a window's anchor is the chosen run with the smallest (hash, place) inside it; each anchor is the minimum of a stretch of windows
    hs, ats = shingles(w, k)
    docs = np.repeat(np.arange(len(w.first) - 1), np.maximum(w.count - k + 1, 0))
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = sliding_min((hs & ~low) | (ats - w.first[docs]).astype(np.uint64), min_words - k + 1)
    ok = docs[: len(best)] == docs[min_words - k :]
    best, bdoc = best[ok], docs[: len(ok)][ok]
    stretch = np.cumsum(np.append(True, (best[1:] != best[:-1]) | (bdoc[1:] != bdoc[:-1]))[: len(best)]) - 1
    take = good[stretch]
    # the second hash is made of other hashes of the words
    g, _ = shingles(Words(mix64(w.hash ^ _SECOND), w.first, w.start, w.end), min_words)
    return h[take], g[take], at[take]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            n = words(b.column("text"), lower=False).count
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("u1"), b.column("u2"), pa.array(n)], ["doc_id", "u1", "u2", "n_words"])


def duplicate_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents of ``min_words`` and more by text, duplicate windows).

    The first has doc_id, u1, u2 (the text's hashes), n_words, owner (the
    smallest doc_id with that text); the second, for owners only: owner, tag,
    place, ref_doc_id, ref_place.
    """
    base = need(docs, "doc_id", "text").filter("doc_id is not null and text is not null").withColumns({"u1": text_hash(F.col("text"), 1), "u2": text_hash(F.col("text"), 2)})
    # shorter texts have no window; among them are the texts that most documents may share, such as the empty one
    ids = base.mapInArrow(_count_words, "doc_id long, u1 long, u2 long, n_words long").filter(F.col("n_words") >= min_words).distinct()
    ids = ids.join(ids.groupBy("u1", "u2").agg(F.min("doc_id").alias("owner")), ["u1", "u2"])
    ids = checkpointed(ids.select("doc_id", "u1", "u2", "n_words", "owner"))

    def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                h, first, doc = anchors(words(b.column("text"), lower=False), min_words)
                if len(h) == 0:
                    continue
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
                n = np.diff(np.append(head, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), b.column("u1").take(pa.array(doc[head])), pa.array(n > 1)], ["a", "u1", "twice"])

    found = base.select("u1", "text").mapInArrow(emit_anchors, "a long, u1 long, twice boolean")
    # a frequent anchor is summed up before the shuffle, and its rows may be split by the join
    often = found.groupBy("a").agg(F.min("u1").alias("lo"), F.max("u1").alias("hi"), F.max("twice").alias("any")).filter("lo <> hi or any").select("a")
    repeated = found.join(often, "a", "left_semi").groupBy("u1").agg(F.collect_set("a").alias("chosen"))
    owners = ids.filter("doc_id = owner").select(F.col("u1").alias("o1"), F.col("u2").alias("o2"), F.col("owner")).distinct()
    units = owners.join(repeated, owners["o1"] == repeated["u1"]).select("o1", "o2", "owner", "chosen")
    text = base.join(units, (base["u1"] == units["o1"]) & (base["u2"] == units["o2"]) & (base["doc_id"] == units["owner"])).select("owner", "u1", "chosen", "text")

    def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                w = words(b.column("text"), lower=False)
                lists = b.column("chosen")
                flat, at = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
                h, g, first = windows_with(w, [flat[s:e] for s, e in zip(at[:-1], at[1:])], min_words)
                if len(h) == 0:
                    continue
                doc = np.searchsorted(w.first, first, side="right") - 1
                # empty documents share their first word's index with the next: the last of them is meant
                place = (first - w.first[doc]).astype(np.uint64)
                if place.max() >> np.uint64(PLACE_BITS):
                    raise ValueError(f"a text has over {1 << PLACE_BITS} words")
                tag = b.column("u1").to_numpy().view(np.uint64)[doc] >> np.uint64(PLACE_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), b.column("owner").take(pa.array(doc)), pa.array(((tag << np.uint64(PLACE_BITS)) | place).view(np.int64))], ["h", "g", "owner", "spot"])

    every = text.mapInArrow(emit_windows, "h long, g long, owner long, spot long")
    place = F.col("spot").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    every = every.select("h", "g", "owner", place.alias("place"), _tag(F.col("spot")).alias("tag")).repartition("h").sortWithinPartitions("h", "g", "owner", "tag", "place")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (h, g, owner, tag, place) of the current window's first occurrence
        for b in batches:
            if b.num_rows == 0:
                continue
            h, g, owner, place, tag = (b.column(i).to_numpy() for i in range(5))
            head = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
            if last is not None and (h[0], g[0]) == last[:2]:
                head[0] = False
            at = np.maximum.accumulate(np.where(head, np.arange(len(h)), -1))
            ref = np.stack([owner[at], tag[at], place[at]], axis=1)
            if last is not None:
                ref[at < 0] = last[2:]
            last = (h[-1], g[-1], *ref[-1])
            dup = (owner != ref[:, 0]) | (tag != ref[:, 1]) | (place != ref[:, 2])
            if dup.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[dup])) for x in (owner, tag, place, ref[:, 0], ref[:, 2])], ["owner", "tag", "place", "ref_doc_id", "ref_place"])

    return ids, every.mapInArrow(mark, "owner long, tag long, place long, ref_doc_id long, ref_place long")


FACTOR = "doc_id long, tag long, span_start long, span_end long, factor_start long, factor_end long, ref_doc_id long, ref_start long"


def factors(dups: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Follow duplicate windows along their references: the factors, trimmed where they overlap, and the spans they join to."""
    ordered = dups.select("owner", "tag", "place", "ref_doc_id", "ref_place").repartition("owner", "tag").sortWithinPartitions("owner", "tag", "place")

    def parse(cols: list[np.ndarray]) -> pa.RecordBatch:
        owner, tag, place, ro, rp = cols
        once = np.append(True, (owner[1:] != owner[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] != place[:-1]))
        owner, tag, place, ro, rp = (x[once] for x in cols)
        unit = np.append(True, (owner[1:] != owner[:-1]) | (tag[1:] != tag[:-1]))
        cut = unit | np.append(True, (place[1:] != place[:-1] + 1) | (ro[1:] != ro[:-1]) | (rp[1:] != rp[:-1] + 1))
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(place)) - 1
        start, end = place[s], place[e] + min_words
        fresh = unit[s] | np.append(True, start[1:] > end[:-1])
        begin = np.where(fresh, start, np.maximum(start, np.append(0, end[:-1])))
        span = np.cumsum(fresh) - 1
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(s)) - 1
        arrays = [owner[s], tag[s], start[heads][span], end[tails][span], begin, end, ro[s], rp[s] + (begin - start)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in arrays], ["doc_id", "tag", "span_start", "span_end", "factor_start", "factor_end", "ref_doc_id", "ref_start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            if b.num_rows == 0:
                continue
            cols = [b.column(i).to_numpy() for i in range(5)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            # the last document may go on in the next batch
            at = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1:].sum() + 1) if ((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])).any() else 0
            rest = [x[at:] for x in cols]
            if at:
                yield parse([x[:at] for x in cols])
        if rest is not None:
            yield parse(rest)

    return ordered.mapInArrow(run, FACTOR)


def duplicate_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans of ``min_words`` words and more that stand word for word earlier in the corpus.

    One row a factor: doc_id, span_start, span_end (words, end exclusive; the
    whole duplicate stretch), factor_start, factor_end (this factor's share of
    it), ref_doc_id, ref_start (where the factor's words stand first). *Earlier*
    is by (doc_id, word). A document whose whole text is another's with a smaller
    doc_id is one span. The first occurrence itself is never a span.

    Words are split at ASCII white space and compared exactly. Null doc_ids and
    null texts take no part. Rows equal in doc_id and text count once. Texts of
    under ``min_words`` words have no spans. Long texts are read whole; one of over
    2**30 words is an error. Other columns are ignored. No rows in, no rows out.
    """
    if min_words < ANCHOR_WORDS:
        raise ValueError(f"min_words must be {ANCHOR_WORDS} at least")
    ids, dups = duplicate_windows(docs, min_words)
    copies = ids.filter(F.col("doc_id") != F.col("owner"))
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("span_start"), F.col("n_words").alias("span_end"), F.lit(0).cast("long").alias("factor_start"), F.col("n_words").alias("factor_end"), F.col("owner").alias("ref_doc_id"), F.lit(0).cast("long").alias("ref_start"))
    return factors(dups, min_words).drop("tag").unionByName(whole)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans (sorted, disjoint), each with the white space after it."""
    w = words(pa.array([text]), lower=False)
    raw = text.encode("utf-8")
    starts = np.append(w.start, len(raw))
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]])
        at = int(starts[min(e, len(starts) - 1)])
    out.append(raw[at:])
    return b"".join(out).decode("utf-8").strip() if spans else text


def drop_duplicate_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every duplicate span cut from its text; columns as they were, ``n_chars`` brought up to date.

    A document with no word left goes; the first occurrence of each passage
    stays where it is. Rows without a duplicate span are returned unchanged, those
    with a null or empty text or a null doc_id among them. Repeated rows are cut
    alike. No column of ``docs`` can clash. An empty table stays empty.
    """
    ids, dups = duplicate_windows(docs, min_words)
    spans = factors(dups, min_words).select("doc_id", "tag", "span_start", "span_end").distinct()
    marks = spans.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias("spans"))
    whole = ids.filter(F.col("doc_id") != F.col("owner"))
    whole = whole.select("doc_id", _tag(F.col("u1")).alias("tag"), F.array(F.struct(F.lit(0).cast("long").alias("span_start"), F.col("n_words").alias("span_end"))).alias("spans"))
    marks = marks.unionByName(whole).select(F.col("doc_id").alias("__rc_id"), F.col("tag").alias("__rc_tag"), F.col("spans").alias("__rc_spans"))
    joined = docs.join(marks, (docs["doc_id"] == marks["__rc_id"]) & (_tag(text_hash(docs["text"], 1)) == marks["__rc_tag"]), "left").drop("__rc_id", "__rc_tag")
    names = list(docs.columns)
    text_at, chars_at, kinds = names.index("text"), names.index("n_chars") if "n_chars" in names else None, dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(names))
            hit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            cols = [b.column(i) for i in range(len(names))]
            if len(hit):
                texts = cols[text_at].to_pylist()
                keep = np.ones(b.num_rows, dtype=bool)
                for i in hit.tolist():
                    texts[i] = cut(texts[i], [(s["span_start"], s["span_end"]) for s in lists[i].as_py()])
                    keep[i] = bool(texts[i])
                cols[text_at] = pa.array(texts, cols[text_at].type)
                if chars_at is not None:
                    chars = cols[chars_at].to_pylist()
                    for i in hit.tolist():
                        chars[i] = len(texts[i])
                    cols[chars_at] = pa.array(chars, cols[chars_at].type)
                yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(cols, names)

    assert kinds["text"] == "string"
    return joined.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return duplicate_spans(table(spark, sf_dir, "documents"))
