"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A byte-level vocabulary in rank order defines the merges: of all neighbouring
pairs the one that makes the token of lowest rank is merged first. The encoder
gets the same tokens without merging. An Aho-Corasick pass over a piece of text
finds the longest vocabulary entry at each byte; going left to right it takes
the longest one that may stand after the token before it, tries the next
shorter entry if it may not, and steps back when none is left. A bit per byte
remembers ends that led nowhere, so each is tried once: time is linear. Whether
two tokens may stand side by side (no merge of ranks crosses their border) is
read from the pair table.

Decoding looks up each id's stretch in one byte string by an offset table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from recollect.llm.arrow_text import slices
from recollect.llm.common import need, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to so many bytes are remembered, at most MEMO of them a worker; longer or further ones are encoded anew.
MEMO_BYTES = 64
MEMO = 400_000


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens in rank order from a file of lines *base64 rank*; the ranks must run from 0 without a gap."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without a gap")
    return [t for _, t in pairs]


class _Pieces(dict):
    """Tokens of the pieces seen, up to a bound."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = self.codec.encode_piece(raw)
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary; every single byte must be a token."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.tokens, self.split = tokens, regex.compile(pattern)
        self.ids = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("every byte must be a token")
        self.size = [len(t) for t in tokens]
        self.machine = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.machine.add_word(t.decode("latin-1"), i)
        self.machine.make_automaton()
        self.shorter = [self._shorter(t) for t in tokens]
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        self._compatible: dict[int, bool] = {}
        for i, t in enumerate(tokens):
            self.halves.append(self._halves(i, t))
        self.offsets = np.append(0, np.cumsum(self.size)).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.memo = _Pieces(self)

    def _shorter(self, token: bytes) -> int:
        """The longest token that is a proper prefix of this one; -1: none."""
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ids.get(token[:n])) is not None:
                return i
        return -1

    def _halves(self, i: int, token: bytes) -> tuple[int, int]:
        """The pair whose merge makes the token, entered in the pair table; (i, i): it isn't made by a merge."""
        a = self.shorter[i]
        while a >= 0:
            b = self.ids.get(token[self.size[a] :])
            if b is not None and a < i and b < i and self._allowed(a, b):
                self.pairs[a, b] = i
                return a, b
            a = self.shorter[a]
        return i, i

    def _allowed(self, a: int, b: int) -> bool:
        """Whether no merge across the border of a and b comes before the merges inside them."""
        pairs, halves, limit = self.pairs, self.halves, 1 << 60
        while True:
            merged = pairs.get((a, b))
            if merged is not None and merged < limit:
                return False
            # undo the later of the two last merges; the sides are tried in turn when one is a single piece
            if a > b:
                limit, right = a, halves[a][1]
                if right != a:
                    a = right
                    continue
                limit, left = b + 1, halves[b][0]
                if left == b:
                    return True
                b = left
            else:
                limit, left = b + 1, halves[b][0]
                if left != b:
                    b = left
                    continue
                limit, right = a, halves[a][1]
                if right == a:
                    return True
                a = right

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 4 * MEMO:
                self._compatible.clear()
            known = self._compatible[key] = self._allowed(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece, as merging it by rank would give them."""
        whole = self.ids.get(piece)
        if whole is not None and self.halves[whole][0] != whole or len(piece) == 1:
            return [whole]
        n, size, shorter = len(piece), self.size, self.shorter
        longest = [-1] * n
        for end, i in self.machine.iter(piece.decode("latin-1")):
            s = end + 1 - size[i]
            if longest[s] < 0 or size[longest[s]] < size[i]:
                longest[s] = i
        out: list[int] = []
        open_ends = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if open_ends[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_ends[at] = 0
                token = out.pop()
                at -= size[token]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split.findall(text))))

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids, by the offset table."""
        start = self.offsets[ids]
        n = self.offsets[ids + 1] - start
        before = np.cumsum(n) - n
        return self.bytes[np.arange(int(n.sum())) + np.repeat(start - before, n)]

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, dtype=np.int64)).tobytes().decode("utf-8", "surrogatepass") if len(ids) else ""


_CODECS: dict[bytes, Codec] = {}


def _codec(tokens: list[bytes], pattern: str) -> Codec:
    """One codec a worker process and vocabulary (all of its tokens, and the pattern, tell vocabularies apart)."""
    digest = hashlib.md5(pattern.encode())
    digest.update(np.array([len(t) for t in tokens], dtype=np.int64).tobytes())
    digest.update(b"".join(tokens))
    key = digest.digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(tokens, pattern)
    return _CODECS[key]


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every row.

    Special tokens are ordinary text. ``round_trip`` says that decoding the ids
    gave the text back; it is computed for each row. The vocabulary is read by
    the driver and broadcast (its size is that of the file, not of the data).

    A null text has null ids, n_tokens and round_trip; an empty one has no ids
    and round_trip true. Null doc_ids and repeated rows are carried along. Long
    texts, also those without white space, are encoded whole. Other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for whole in batches:
            for b in slices(whole, "text"):
                codec = codec or _codec(shared.value, pattern)
                texts = b.column("text").to_pylist()
                coded = [None if t is None else codec.encode(t) for t in texts]
                n = np.array([len(c) if c is not None else 0 for c in coded], dtype=np.int64)
                flat = np.fromiter((i for c in coded if c for i in c), dtype=np.int64, count=int(n.sum()))
                back = codec.decode_bytes(flat).tobytes()
                # bytes of each row's tokens: where its text must stand in the decoded string
                ends = np.append(0, np.cumsum(codec.offsets[flat + 1] - codec.offsets[flat]))[np.append(0, np.cumsum(n))].tolist()
                same = [None if t is None else back[s:e] == t.encode("utf-8", "surrogatepass") for t, s, e in zip(texts, ends[:-1], ends[1:])]
                null = np.array([c is None for c in coded])
                at = pa.array(np.append(0, np.cumsum(n)).astype(np.int32), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int32), mask=null), pa.ListArray.from_arrays(at, pa.array(flat.astype(np.int32))), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens int, ids array<int>, round_trip boolean")


def bpe_decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): each id's bytes by the offset table.

    Null ids give a null text, no ids an empty one. A null among the ids, or an id
    outside the vocabulary, makes the row's text null. Bytes that aren't UTF-8, from
    ids no encoder gave, become U+FFFD. Null doc_ids and repeated rows are carried
    along, long lists are decoded whole, other columns are ignored.
    """
    shared = coded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        offsets = np.append(0, np.cumsum([len(t) for t in tokens])).astype(np.int64)
        pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        for b in batches:
            lists = b.column("ids")
            ids = pc.fill_null(lists.flatten(), -1).to_numpy().astype(np.int64)
            wrong = (ids < 0) | (ids >= len(tokens))
            ids = np.where(wrong, 0, ids)
            n = offsets[ids + 1] - offsets[ids]
            upto = np.append(0, np.cumsum(n))
            raw = pool[np.arange(int(n.sum())) + np.repeat(offsets[ids] - upto[:-1], n)].tobytes()
            counts = lists.value_lengths().fill_null(0).to_numpy()
            rows = np.append(0, np.cumsum(counts))
            ends = upto[rows].tolist()
            bad = np.append(0, np.cumsum(wrong))[rows]
            valid = (lists.is_valid().to_numpy(zero_copy_only=False) & (bad[1:] == bad[:-1])).tolist()
            texts = [raw[s:e].decode("utf-8", "replace") if ok else None for s, e, ok in zip(ends[:-1], ends[1:], valid)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return need(coded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"))
