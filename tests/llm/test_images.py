import numpy as np

from recollect.llm.images import MIN_INLIERS, RADIUS, TABLES, WORD, _resize, consensus, copy_classes, describe, descriptors, embedding_thumbnails, find_copies

SCHEMA = "image_id long, width int, height int, pixels binary, t int, word long"


def scene(rng, size=160):
    x = _resize(rng.random((1, size // 10, size // 10)), size, size)[0] * 120
    for _ in range(25):
        y, z, h, w = rng.integers(0, size - 20, 2).tolist() + rng.integers(6, 28, 2).tolist()
        x[y : y + h, z : z + w] += rng.uniform(-90, 90)
    return np.clip(x + 70, 0, 255)


def row(i, x):
    return (i, x.shape[1], x.shape[0], np.rint(np.clip(x, 0, 255)).astype(np.uint8).tobytes(), 1, 2)


def test_copies_are_found_and_others_not(spark):
    rng = np.random.default_rng(1)
    scenes = [scene(rng) for _ in range(12)]
    rows, want = [row(i, s) for i, s in enumerate(scenes)], set()
    for i, s in enumerate(scenes[:8]):
        edits = [s[20:140, 30:150], np.clip(s * 0.8 + 30, 0, 255), np.rot90(s), _resize(s[None], 113, 113)[0], s + rng.normal(0, 4, s.shape)]
        e = edits[i % 5]
        if i % 5 == 0:
            e = e.copy()
            e[50:70, 50:75] = 255
        rows.append(row(100 + i, e))
        want.add((i, 100 + i))
    got = {(r["image_id"], r["copy_id"]) for r in find_copies(spark.createDataFrame(rows, SCHEMA), min_inliers=6).collect()}
    assert got == want


def test_tables_are_words_of_the_descriptor(spark):
    rng = np.random.default_rng(2)
    d = descriptors(spark.createDataFrame([row(1, scene(rng))], SCHEMA))
    from pyspark.sql import functions as F

    from recollect.llm.images import _word

    for r in d.select("d0", "d1", "d2", "d3", F.array(*[_word(t, "") for t in range(TABLES)]).alias("w")).limit(20).collect():
        bits = sum((r[f"d{k}"] & (1 << 64) - 1) << 64 * k for k in range(4))
        assert list(r["w"]) == [bits >> t * WORD & (1 << WORD) - 1 for t in range(TABLES)]


def turned(x, degrees):
    """Turned about the middle, bilinear; what comes from outside is black."""
    h, w = x.shape
    t = np.deg2rad(degrees)
    yy, xx = np.mgrid[:h, :w]
    sy = np.cos(t) * (yy - h / 2) - np.sin(t) * (xx - w / 2) + h / 2
    sx = np.sin(t) * (yy - h / 2) + np.cos(t) * (xx - w / 2) + w / 2
    y0, x0 = np.clip(np.floor(sy).astype(int), 0, h - 2), np.clip(np.floor(sx).astype(int), 0, w - 2)
    fy, fx = np.clip(sy - y0, 0, 1), np.clip(sx - x0, 0, 1)
    out = (x[y0, x0] * (1 - fx) + x[y0, x0 + 1] * fx) * (1 - fy) + (x[y0 + 1, x0] * (1 - fx) + x[y0 + 1, x0 + 1] * fx) * fy
    return np.where((sy < 0) | (sy > h - 1) | (sx < 0) | (sx > w - 1), 0, out)


EDITS = {
    "cropped": lambda rng, s: s[len(s) // 8 : -len(s) // 8, len(s) // 5 :],
    "noisy": lambda rng, s: s + rng.normal(0, 12, s.shape),
    "darker": lambda rng, s: s * 0.7 + 20,
    "between two scales": lambda rng, s: _resize(s[None], round(len(s) * 0.84), round(len(s) * 0.84))[0],
    "larger": lambda rng, s: _resize(s[None], round(len(s) * 1.3), round(len(s) * 1.3))[0],
    "turned by 17": lambda rng, s: turned(s, 17),
    "turned by 123": lambda rng, s: turned(s, 123),
}


def all_pairs(spark, rows, radius):
    """Copies by comparing every two descriptors, with the same consensus."""
    d = descriptors(spark.createDataFrame(rows, SCHEMA)).toPandas()
    bits = d[["d0", "d1", "d2", "d3"]].to_numpy().view(np.uint64)
    own, spot = d["image_id"].to_numpy(), d["spot"].to_numpy()
    out, matches = {}, {}
    for i in sorted(set(own)):
        for j in sorted(set(own)):
            if i < j:
                a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
                x, y = np.nonzero(np.bitwise_count(bits[a][:, None] ^ bits[b][None]).sum(axis=2) <= radius)
                if len(x) and (found := consensus(own[a[x]], own[b[y]], spot[a[x]], spot[b[y]], MIN_INLIERS)).num_rows:
                    out[int(i), int(j)] = found.column(2)[0].as_py()
                matches[int(i), int(j)] = len(x)
    return out, matches


def test_recall_against_all_pairs(spark):
    """Edited copies, and images that aren't: nine in ten of the pairs and corners that comparing everything finds, and no other pair."""
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for k, (_, edit) in enumerate(EDITS.items()):
        for n, size in enumerate((200, 320)):
            s = scene(rng, size)
            rows += [row(10 * k + n, s), row(100 + 10 * k + n, edit(rng, s))]
            want.add((10 * k + n, 100 + 10 * k + n))
    brute, _ = all_pairs(spark, rows, RADIUS)
    got = {(r["image_id"], r["copy_id"]): r["inliers"] for r in find_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert want <= set(brute) and set(got) <= set(brute) and set(got) <= want
    assert len(got) >= 0.9 * len(brute) and sum(got.values()) >= 0.9 * sum(brute.values())


def test_large_images(spark):
    """A thousand pixels and more: resized between two scales, and turned by an odd angle."""
    rng = np.random.default_rng(8)
    s = scene(rng, 900)
    rows = [row(1, s), row(2, EDITS["between two scales"](rng, s)), row(3, EDITS["turned by 17"](rng, s)), row(4, scene(rng, 900)), row(5, np.pad(s[:300, :300], ((0, 0), (0, 40_000))))]
    got = {(r["image_id"], r["copy_id"]) for r in find_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(1, 2), (1, 3), (2, 3), (1, 5)} <= got and not any(4 in p for p in got)


def test_words_meet_at_the_full_radius():
    """Share of descriptors, RADIUS bits apart at random, that have a word in common."""
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(4000):
        off = np.zeros(256, bool)
        off[rng.choice(256, RADIUS, replace=False)] = True
        met += any(not off[t * WORD : (t + 1) * WORD].any() for t in range(TABLES))
    assert met >= 0.9 * 4000


def test_edges(spark):
    rng = np.random.default_rng(4)
    s = scene(rng)
    flat = np.full((40, 40), 9.0)
    rows = [row(1, s), row(1, s), row(2, s), (3, None, 4, b"abcd", 1, 2), (4, 4, 4, None, 1, 2), (5, 4, 4, b"short", 1, 2), (None, 4, 4, b"x" * 16, 1, 2), row(6, flat), row(7, flat), row(8, scene(rng)[:5, :5]), (9, 0, 0, b"", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["image_id"], r["copy_id"], r["identical"]) for r in find_copies(df).collect()}
    assert got == {(1, 2, True), (6, 7, True)}
    assert find_copies(df.limit(0)).count() == 0
    e = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, [1.0, None] * 32), (4, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r["image_id"] for r in embedding_thumbnails(e).collect()] == [1]


def test_classes_have_a_row_an_image_and_lose_no_link(spark):
    """Against the pairs written out: groups of edited and of identical copies, and images alone."""
    rng = np.random.default_rng(12)
    rows = [row(90, scene(rng)), row(91, scene(rng)), (92, None, 4, b"abcd", 1, 2), (None, 4, 4, b"x" * 16, 1, 2)]
    for k in range(2):
        s = scene(rng)
        rows += [row(10 * k + n, s + rng.normal(0, 3, s.shape)) for n in range(6)]
        rows += [(10 * k + 7, *rows[-1][1:]), (10 * k + 8, *rows[-1][1:]), (10 * k + 9, *rows[-3][1:])]
    rows += [rows[0], rows[6]]
    images = spark.createDataFrame(rows, SCHEMA)
    pixels = {r[0]: r[1:4] for r in rows}
    ids = sorted(i for i in pixels if i is not None and i != 92)
    near = {frozenset((r["image_id"], r["copy_id"])) for r in find_copies(images).filter("not identical").collect()}
    first = {i: min(j for j in ids if pixels[j] == pixels[i]) for i in ids}
    links = {i: {j for j in ids if j != i and (first[i] == first[j] or frozenset((first[i], first[j])) in near)} for i in ids}
    name = {i: i for i in ids}
    for _ in ids:
        name = {i: min([name[i], *(name[j] for j in links[i])]) for i in ids}
    got = [(r["image_id"], r["class_id"], r["links"]) for r in copy_classes(images).collect()]
    assert sorted(got) == [(i, name[i], len(links[i])) for i in ids]
    assert {name[i] for i in ids} == {0, 10, 90, 91} and sum(map(len, links.values())) > 100
    assert copy_classes(images.limit(0)).count() == 0


def test_rows_of_the_query_grow_with_the_images(spark, tmp_path):
    """A query over copies of one picture, each with a spot changed, returns a row an image, not a row a pair."""
    from recollect.llm.images import query

    rng = np.random.default_rng(13)
    v = rng.random(64)
    for n in (8, 16):
        e = [(i, [float(x + (0.02 * rng.random() if k == i else 0)) for k, x in enumerate(v)]) for i in range(n)]
        (tmp_path / str(n)).mkdir()
        spark.createDataFrame(e, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        got = query(spark, f"{tmp_path}/{n}").collect()
        assert sorted(r["image_id"] for r in got) == list(range(n)) and {r["class_id"] for r in got} == {0} and all(r["links"] >= n // 2 for r in got)
