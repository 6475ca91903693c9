"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A
document is parsed against it greedily: each phrase is the longest match that
the sample holds from there on (one character where it holds none). With c
phrases over N characters and a sample of n characters, c * log2(n) / N
estimates the cross entropy in bits a character (Ziv and Merhav); the language
with the least wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.arrow_text import slices
from recollect.llm.common import need, table

#: Bounds of the labelled sample: characters and documents a language.
SAMPLE_CHARS = 48_000
SAMPLE_DOCS = 256
#: Bytes of text parsed side by side, all documents of them a character further at a time: the longest one says how many steps there are.
SIDE_BY_SIDE = 16 << 20

#: Cells of the table that holds automata in full; those that do not fit are kept by their transitions alone.
DENSE_CELLS = 1 << 26

_OTHER, _GAP = 0, 1
_STEP = 29
_MASK = (1 << _STEP) - 1


def normalise(text: str) -> str:
    """Lower case, everything but letters a space."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    trans: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return trans


class Parser:
    """The languages' automata: small ones in one table of 'state and character to next state and phrases ended', the others as sorted transitions.

    The table takes the languages of the smallest alphabets, as many as
    ``dense_cells`` hold, whose letters get the first codes. Neither the number of
    languages nor their alphabets are bounded; both forms count the same phrases.
    """

    def __init__(self, samples: dict[str, str], dense_cells: int = DENSE_CELLS):
        self.languages = sorted(samples)
        texts = [normalise(samples[k]) for k in self.languages]
        alphabets = [sorted(set(t) - {" "}) for t in texts]
        self.bits = np.log2([max(len(t), 2) for t in texts])
        letters: dict[str, int] = {}
        automata = {}
        cells, self.dense, self.sparse, self.narrow = 0, [], [], 2
        for k in sorted(range(len(texts)), key=lambda k: (len(alphabets[k]), k)):
            new = [c for c in alphabets[k] if c not in letters]
            letters.update(zip(new, range(len(letters) + 2, len(letters) + 2 + len(new))))
            codes = [letters[c] if c != " " else _GAP for c in texts[k]]
            trans = suffix_automaton(codes)
            n = len(trans)
            automata[k] = (n, np.repeat(np.arange(n), [len(x) for x in trans]), np.fromiter((c for x in trans for c in x), dtype=np.int64), np.fromiter((s for x in trans for s in x.values()), dtype=np.int64))
            if not self.sparse and (cells + n) * (len(letters) + 2) <= min(dense_cells, _MASK):
                cells += n
                self.dense.append(k)
                self.narrow = len(letters) + 2
            else:
                self.sparse.append(k)
        self.width = len(letters) + 2
        self.code = np.zeros(0x110000, dtype=np.uint8 if self.width <= 256 else np.uint32)
        # what is no letter is a gap; a letter that no sample holds is matched by none
        self.code[:] = _GAP
        self.code[self._letters()] = _OTHER
        self.code[np.array([ord(c) for c in letters], dtype=np.int64)] = np.arange(2, self.width)
        tables, roots, base = [], [], 0
        for k in self.dense:
            n, rows, cols, to = automata.pop(k)
            root = base * self.narrow
            start = np.full(self.narrow, root | (1 << _STEP), dtype=np.int64)  # a character the sample lacks: a phrase of its own
            # the phrase before ends, the next begins with c
            start[cols[rows == 0]] = ((base + to[rows == 0]) * self.narrow) | (1 << _STEP)
            absent = start == (root | (1 << _STEP))
            full = np.tile(np.where(absent, start + (1 << _STEP), start).astype(np.int32), (n, 1))
            full[0] = np.where(absent, start, start - (1 << _STEP))
            full[rows, cols] = (to + base) * self.narrow
            tables.append(full.ravel())
            roots.append(root)
            base += n
        self.table, self.roots = np.concatenate(tables) if tables else np.zeros(0, np.int32), np.array(roots, dtype=np.int32)
        self.edges = []
        for k in self.sparse:
            n, rows, cols, to = automata.pop(k)
            key = rows * self.width + cols
            order = np.argsort(key)
            start = np.zeros(self.width, dtype=np.int64)  # 0: the sample lacks the character
            start[cols[rows == 0]] = to[rows == 0]
            self.edges.append((np.append(key[order], np.iinfo(np.int64).max), np.append(to[order], 0), start))

    @staticmethod
    def _letters() -> np.ndarray:
        return np.array([i for i in range(0x30000) if chr(i).isalpha()], dtype=np.int64)

    def phrases(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(phrases a document and language, characters a document); each text is parsed from its first to its last character."""
        low = pc.utf8_lower(pc.fill_null(col, ""))
        chars = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = self.code[np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        doc = np.flatnonzero(chars)
        doc = doc[np.argsort(-chars[doc], kind="stable")]
        start, size = (np.cumsum(chars) - chars)[doc], chars[doc]
        active = len(doc) - np.searchsorted(size[::-1], np.arange(1, int(size[0]) + 1)) if len(size) else []
        out = np.zeros((len(chars), len(self.languages)), dtype=np.int64)
        if self.dense:
            known = codes if self.narrow == self.width else np.where(codes < self.narrow, codes, _OTHER)
            state = np.tile(self.roots[:, None], (1, len(doc)))
            count = np.zeros(state.shape, dtype=np.int32)
            for j, k in enumerate(active):
                s = self.table[state[:, :k] + known[start[:k] + j]]
                count[:, :k] += s >> _STEP
                state[:, :k] = s & _MASK
            count += state != self.roots[:, None]
            own = np.zeros((len(chars), len(self.dense)), dtype=np.int64)
            np.add.at(own, doc, count.T)
            out[:, self.dense] = own
        for language, (key, to, begin) in zip(self.sparse, self.edges):
            state, count = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64)
            for j, k in enumerate(active):
                c, at = codes[start[:k] + j], state[:k]
                want = at * self.width + c
                i = np.searchsorted(key, want)
                hit = key[i] == want
                # no such transition: the phrase ends, and a character that the sample lacks is one of its own
                count[:k] += ~hit & (at != 0)
                count[:k] += begin[c] == 0
                state[:k] = np.where(hit, to[i], begin[c])
            np.add.at(out[:, language], doc, count + (state != 0))
        return out, chars


_PARSERS: dict[str, Parser] = {}


def _parser(samples: dict[str, str]) -> Parser:
    key = hashlib.md5(repr(sorted(samples.items())).encode()).hexdigest()
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(samples)
    return _PARSERS[key]


def labelled_sample(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, sample_docs: int = SAMPLE_DOCS) -> dict[str, str]:
    """Text per language: labelled documents in order of a hash of doc_id, ``sample_docs`` at most, until they hold ``sample_chars``, where the last is cut.

    No more than ``sample_chars`` and one document of each language reach the driver.
    """
    known = need(docs, "doc_id", "lang", "text").filter("doc_id is not null and lang is not null and text is not null and text <> ''").withColumn("n", F.length("text").cast("long"))
    # sizes alone decide, so few texts are read for it: those that begin before the bound
    ids = known.select("doc_id", "lang", "n", F.xxhash64("text").alias("h")).withColumn("nr", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h"))).filter(F.col("nr") <= sample_docs)
    before = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("lang").orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = ids.withColumn("before", before).filter(F.col("before") < sample_chars).select("doc_id", "lang", "h", "nr")
    picked = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long, lang string, h long, nr int")
    # of rows that are equal in id, language and text one is taken for each number it was given
    twins = Window.partitionBy("doc_id", "lang", "h").orderBy("doc_id")
    rows = known.select("doc_id", "lang", F.xxhash64("text").alias("h"), "text").join(F.broadcast(picked.select("doc_id", "lang", "h").distinct()), ["doc_id", "lang", "h"], "left_semi")
    rows = rows.withColumn("k", F.row_number().over(twins)).filter("k = 1").drop("k").join(F.broadcast(picked), ["doc_id", "lang", "h"]).select("lang", "nr", "text").collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["nr"])):
        out[r["lang"]] = out[r["lang"]] + " " + r["text"] if r["lang"] in out else r["text"]
    return {k: v[:sample_chars] for k, v in out.items() if v.strip()}


def identify(docs: DataFrame, samples: dict[str, str] | None = None, sample_chars: int = SAMPLE_CHARS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, language, entropy, runner_up, margin, n_chars) of every row.

    ``language`` has the least ``entropy`` (bits a character; of equal ones the
    first by name), ``margin`` is how much more ``runner_up`` has. ``samples`` maps
    languages to text; by default it is drawn from the rows' own ``lang`` labels,
    within the two bounds. Whole texts are parsed.

    Null and empty texts have no language, entropy, runner-up or margin. A null
    ``doc_id`` is carried along, a null ``lang`` takes no part in the sample.
    Repeated rows are judged alike. With one language there is no runner-up; with
    no labelled text every language is null. Other columns are ignored.
    """
    samples = labelled_sample(docs, sample_chars, sample_docs) if samples is None else samples
    schema = "doc_id long, language string, entropy double, runner_up string, margin double, n_chars long"
    names = ["doc_id", "language", "entropy", "runner_up", "margin", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SIDE_BY_SIDE):
                n = b.num_rows
                best = second = np.zeros(n, dtype=np.int64)
                chars = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                languages: list[str | None] = [None]
                low, gap = np.zeros(n), np.zeros(n)
                if samples:
                    parser = _parser(samples)
                    count, chars = parser.phrases(b.column("text"))
                    bits = count * parser.bits / np.maximum(chars, 1)[:, None]
                    languages = parser.languages
                    order = np.argsort(bits, axis=1, kind="stable")
                    best = order[:, 0]
                    low = bits[np.arange(n), best]
                    if len(languages) > 1:
                        second = order[:, 1]
                        gap = bits[np.arange(n), second] - low
                none = (chars == 0) | (not samples)
                name = pa.array(languages, pa.string())
                single = none | (len(languages) < 2)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), name.take(pa.array(best, mask=none)), pa.array(low, mask=none), name.take(pa.array(second, mask=single)), pa.array(gap, mask=single), pa.array(chars)], names
                )

    return need(docs, "doc_id", "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
