import base64
import random

import zstandard

from recollect.llm.quality_rules import BANDS, compression_bands, keep_good

from .conftest import DOCS, prose


def naive(text):
    """Reason by the rules, one step at a time."""
    raw = (text or "").encode()
    if not raw.strip():
        return "empty"
    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    ratio = len(raw) / size(raw)
    band = max((b for b in BANDS if b.from_bytes <= len(raw)), key=lambda b: b.from_bytes)
    if ratio > band.highest:
        return "repetitive"
    if ratio < band.lowest:
        return "incompressible"
    bad = 0
    for at in range(0, len(raw), 2048):
        chunk = raw[at : at + 2048]
        own = max((b for b in BANDS if b.from_bytes <= len(chunk)), key=lambda b: b.from_bytes)
        bad += 0 if own.lowest <= len(chunk) / size(chunk) <= own.highest else len(chunk)
    return "chunks" if bad / len(raw) > 0.3 else None


def test_against_naive(spark):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (1, 5, 40, 200, 900, 3000, 9000)]
    texts += ["spam eggs " * n for n in (2, 20, 300, 3000)] + [base64.b64encode(rng.randbytes(n)).decode() for n in (40, 400, 4000, 40000)]
    texts += [prose(rng, 1500) + "lorem " * 3000, prose(rng, 4000) + base64.b64encode(rng.randbytes(9000)).decode(), None, "", " \n"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in compression_bands(docs).collect()}
    assert {i: r["reason"] for i, r in got.items()} == {i: naive(t) for i, t in enumerate(texts)}
    assert all(r["keep"] == (r["reason"] is None) for r in got.values())
    assert all(got[i]["keep"] for i in range(7)), "prose of any length stays"
    assert {got[i]["reason"] for i in (9, 10)} == {"repetitive"} and got[13]["reason"] == "incompressible"
    assert got[16]["reason"] == "chunks" and got[0]["n_chunks"] == 1
    assert {r["doc_id"] for r in keep_good(docs).collect()} == {i for i, r in got.items() if r["keep"]}


def test_chunks_of_texts_of_every_length(spark):
    """Noise or one line over and over, half of a text that is prose on the whole: found at lengths above one chunk."""
    rng = random.Random(3)
    texts = []
    for n in (400, 800, 3000):
        good = prose(rng, n)
        texts += [good, good + base64.b64encode(rng.randbytes(len(good) * 3 // 4)).decode(), good + " buy now" * (len(good) // 8)]
    got = {r["doc_id"]: r for r in compression_bands(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)).collect()}
    assert [got[i]["keep"] for i in range(len(texts))] == [True, False, False] * 3
    assert {i: r["reason"] for i, r in got.items()} == {i: naive(t) for i, t in enumerate(texts)} and "chunks" in {r["reason"] for r in got.values()}
    assert all(got[i]["n_chunks"] == -(-len(t.encode()) // 2048) for i, t in enumerate(texts))


def test_edges(nasty, empty):
    rows = compression_bands(nasty).collect()
    assert len(rows) == nasty.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["reason"] == by[5]["reason"] == by[6]["reason"] == "empty" and by[9]["reason"] == by[10]["reason"] == "repetitive"
    assert by[7]["keep"] and by[7]["n_chunks"] > 60
    assert keep_good(nasty).columns == nasty.columns
    assert compression_bands(empty).count() == 0 and keep_good(empty).count() == 0
