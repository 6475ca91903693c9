import base64
import random

import tiktoken

from recollect.llm.bpe import PATTERN, VOCABULARY, Codec, bpe_decode, bpe_encode, read_vocabulary

from .conftest import prose


def merge_by_rank(codec, piece):
    """Byte-pair merging as defined: the leftmost pair of least rank first."""
    parts = [bytes([b]) for b in piece]
    while True:
        ranks = [(codec.ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in codec.ids]
        if not ranks:
            return [codec.ids[p] for p in parts]
        _, i = min(ranks)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def noise(rng, n):
    return "".join(rng.choice(["a", "b", "e", "th", "the", " ", "  ", "\n", "é", "ß", "日", "ing", "1", "23", "!", "##", "\U0001f600", "'s", " "]) for _ in range(n))


def test_pieces_against_merging():
    codec = Codec(read_vocabulary(VOCABULARY))
    rng = random.Random(7)
    for _ in range(1500):
        piece = noise(rng, rng.randint(1, 12)).encode() if rng.random() < 0.7 else rng.randbytes(rng.randint(1, 16))
        assert codec.encode_piece(piece) == merge_by_rank(codec, piece)


def test_small_vocabulary_needs_backtracking():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aaa"]
    codec = Codec(tokens)
    rng = random.Random(1)
    for _ in range(2000):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 14)))
        assert codec.encode_piece(piece) == merge_by_rank(codec, piece)


def test_texts_against_tiktoken_and_round_trip(spark):
    tokens = read_vocabulary(VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(11)
    texts = [noise(rng, rng.randint(0, 80)) for _ in range(300)] + [prose(rng, 500), "a" * 20_000, " " * 5000, "<|endoftext|>", "xyz" * 3000]
    rows = [(i, t) for i, t in enumerate(texts)]
    coded = bpe_encode(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in coded.collect()}
    assert all(got[i]["ids"] == other.encode_ordinary(t) and got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["round_trip"] for i, t in rows)
    assert {r["doc_id"]: r["text"] for r in bpe_decode(coded).collect()} == dict(rows)


def test_vocabularies_that_agree_at_the_end(spark, tmp_path):
    """Each is encoded by its own codec, also within one worker."""
    rest = [b"x%d" % i for i in range(600)]
    for name, pair in (("one", b"ab"), ("two", b"cd")):
        tokens = [bytes([b]) for b in range(256)] + [pair] + rest
        (tmp_path / name).write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    docs = spark.createDataFrame([(1, "abcd")], "doc_id long, text string").coalesce(1)
    got = {name: bpe_encode(docs, str(tmp_path / name)).first()["ids"] for name in ("one", "two")}
    assert got == {"one": [256, 99, 100], "two": [97, 98, 256]}


def test_odd_ids(spark):
    rows = [(1, [64, None]), (2, [10**6]), (3, [-1, 64]), (4, []), (5, None), (None, [64]), (6, [64, 65])]
    got = [(r["doc_id"], r["text"]) for r in bpe_decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()]
    tokens = read_vocabulary(VOCABULARY)
    assert got == [(1, None), (2, None), (3, None), (4, ""), (5, None), (None, tokens[64].decode()), (6, (tokens[64] + tokens[65]).decode())]


def test_edges(nasty, empty):
    rows = bpe_encode(nasty)
    got = rows.collect()
    assert len(got) == nasty.count() and all(r["round_trip"] for r in got if r["ids"] is not None)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["ids"] is None and by[4]["round_trip"] is None and by[5]["ids"] == [] and by[5]["n_tokens"] == 0
    back = sorted((r["doc_id"] or 0, r["text"] or "") for r in bpe_decode(rows).collect())
    assert back == sorted((r["doc_id"] or 0, r["text"] or "") for r in nasty.select("doc_id", "text").collect())
    assert bpe_encode(empty).count() == 0
