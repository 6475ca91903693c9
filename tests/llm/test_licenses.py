import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.llm.licenses import BANDS, CONTAINMENT, LEAST, ROWS, SHINGLE, TEMPLATES, collision, index, normalise, scan, shingles, words

from .conftest import DOCS, prose


def plain(text):
    return normalise(pa.array([text])).to_pylist()[0].split()


def brute(text):
    """Names of the templates that some stretch of the text holds, by sliding a stretch of the template's width over it."""
    w, out = plain(text), set()
    for name, t in TEMPLATES.items():
        goal = {tuple(x) for x in zip(*(plain(t)[k:] for k in range(SHINGLE)))}
        mine = list(zip(*(w[k:] for k in range(SHINGLE))))
        n = len(goal)
        if any(len(goal & set(mine[s : s + 4 * n])) >= CONTAINMENT * n - 1e-9 for s in range(max(1, len(mine)))):
            out.add(name)
    return out


def test_bands_guarantee_collision():
    assert collision(LEAST, BANDS, ROWS) > 0.99
    ix = index(TEMPLATES)
    for n, w in zip(ix.length, ix.width):
        # whole template in one window of the grid, at the similarity the bands are set for
        assert w - w // 4 >= n and n * CONTAINMENT / (w + n * (1 - CONTAINMENT)) >= LEAST * 0.8


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for name, t in list(TEMPLATES.items()) * 3:
        w = t.split()
        if len(w) > 25:
            for _ in range(len(w) // 20):
                w[rng.randrange(len(w))] = "changed"
        texts.append(prose(rng, rng.randint(0, 300)) + "\n * " + " ".join(w).upper() + " * " + prose(rng, rng.randint(0, 300)))
    texts += [prose(rng, 400) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got: dict[int, set] = {}
    for r in scan(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
        assert r["containment"] >= CONTAINMENT - 1e-9
        w = plain(texts[r["doc_id"]])
        own = set(plain(TEMPLATES[r["license"]]))
        assert len(own & set(w[r["first_word"] : r["end_word"]])) >= CONTAINMENT * len(own)
    want = {i: b for i, t in enumerate(texts) if (b := brute(t))}
    pairs = {(i, x) for i, b in want.items() for x in b}
    have = {(i, x) for i, b in got.items() for x in b}
    assert have <= pairs and len(have) >= 0.98 * len(pairs) and len(pairs) >= 3 * len(TEMPLATES)


def test_two_copies_two_rows(spark):
    t = TEMPLATES["gpl-notice"]
    rng = random.Random(1)
    docs = spark.createDataFrame([(1, f"{t} {prose(rng, 400)} {t}", "en", "s", 0)], DOCS)
    assert [r["license"] for r in scan(docs).collect()].count("gpl-notice") == 2
    assert np.array(words(pa.array(["a"])).hash).size == 1 and shingles(words(pa.array(["a"])), 2)[0].size == 0


def test_edges(spark, nasty, empty):
    assert scan(nasty).count() == 0 and scan(empty).count() == 0
    # the same rows with a licence in every text: null ids, repeats, a long text and clashing names meet a match
    notice = TEMPLATES["isc-grant"]
    rows = nasty.withColumn("text", F.concat("text", F.lit("\n"), F.lit(notice)))
    assert rows.filter("text is not null").count() == 14
    got = scan(rows).filter("license = 'isc-grant'").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows.filter("text is not null").collect())
    assert all(r["containment"] == 1.0 for r in got) and max(r["first_word"] for r in got) >= 30_000


def test_whole_licences(spark):
    """The full texts, in windows of hundreds of shingles, wherever they stand and with a twentieth of their words changed."""
    rng = random.Random(19)
    names = [n for n in TEMPLATES if n.endswith("-full")]
    rows = []
    for name in names * 4:
        w = TEMPLATES[name].split()
        for _ in range(len(w) // 20):
            w[rng.randrange(len(w))] = "changed"
        rows.append((len(rows), f"{prose(rng, rng.randint(0, 900))}\n{' '.join(w)}\n{prose(rng, rng.randint(0, 900))}", "en", "s", 0))
    ix = index(TEMPLATES)
    assert len(names) >= 9 and max(ix.width) >= 512
    got = {(r["doc_id"], r["license"]) for r in scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum((i, names[i % len(names)]) in got for i in range(len(rows))) >= 0.97 * len(rows)


def test_lines_as_they_stand_in_documents(spark):
    """Lines of the test tables, not made from TEMPLATES; the bare notice has two shingles and stands anywhere, also alone or changed in one word."""
    lines = {
        "all-rights-reserved-name": ["All rights reserved.", "ALL RIGHTS RESERVED", "(c) 2019 Some Press -- all rights reserved"],
        "gpl-3.0-name": ["This program is licensed under the GNU General Public License, version 3."],
        "cc-by-nc-4.0-name": ["This work is licensed under CC BY-NC 4.0."],
    }
    rng = random.Random(8)
    rows, want = [], {}
    for name, texts in lines.items():
        for line in texts:
            for before, after in ((0, 0), (0, 40), (40, 0), *((rng.randint(1, 400), rng.randint(1, 400)) for _ in range(25))):
                want[len(rows)] = {name}
                rows.append((len(rows), f"{prose(rng, before)}\n{line}\n{prose(rng, after)}", "en", "s", 0))
    for line in ("all rights belong to them", "no rights reserved", "reserved rights all"):
        rows.append((len(rows), f"{prose(rng, 50)}\n{line}\n{prose(rng, 50)}", "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    got: dict[int, set] = {}
    for r in scan(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    short = {i for i, x in want.items() if x == {"all-rights-reserved-name"}}
    assert {i: x for i, x in got.items() if i in short or i not in want} == {i: want[i] for i in short}
    # these are found by bands, of which each window shares one with a probability of over 0.99
    assert sum(got.get(i) == x for i, x in want.items()) >= 0.98 * len(want)
    alone = scan(docs, {"bare": "All rights reserved."}).collect()
    assert {r["doc_id"] for r in alone} == short and all(r["end_word"] - r["first_word"] == 3 for r in alone)
