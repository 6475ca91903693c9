"""Copies among images: local binary descriptors, Hamming tables and geometric consensus.

Each grey image is searched for corners at several scales. Around each corner a
patch is turned by its own orientation (the direction of its intensity
centroid) and 256 pairs of points are compared, a bit each. Descriptors meet in
tables: 252 bits are 14 words of 18 bits, and two descriptors are compared if a
word is equal; they match within ``radius`` bits. With 24 of 256 bits different,
at random places, an equal word is there with a probability of 0.93, with fewer
bits more often.

Every match says how one image would have to be scaled, turned and shifted onto
the other, from its own place on. The motion that most of the pair's other
matches agree with is fitted to them anew and held against all; an image pair
with enough corners on one motion is a copy, however it was cropped, brightened,
turned or resized. Places and distances are relative to the images' sides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import checkpointed, need, table
from recollect.llm.components import components

SCALES = (1.0, 0.7071067811865476, 0.5)
PATCH = 15
CORNER_SHARE = 0.02
TABLES, WORD = 14, 18
RADIUS = 24
MIN_INLIERS = 4
#: How far a corner may be off, in pixels of its own scale; and, as a share of its distance, from a motion read off one match and from a fitted one.
OFF_PIXELS, OFF_ONE, OFF_FITTED = 3.0, 0.25, 0.03
#: How far a match's own turn (radians) and scale (octaves) may differ from the motion's.
OFF_TURN, OFF_SCALE = 0.6, 0.75
_TURNS = 32
_IMAGES_AT_ONCE = 64


def _pattern() -> np.ndarray:
    """256 pairs of points in the patch, for each of the orientations: (turns, 256, 2, 2), rounded to pixels.

    A pair lies across the orientation: what is left and right of it is as often
    lighter as darker, so that the bits, and the words made of them, are spread evenly.
    """
    rng = np.random.default_rng(20)
    points = np.clip(rng.normal(0, PATCH / 1.8, (4000, 2, 2)), 3 - PATCH, PATCH - 3)
    points[:, 1, 0] = points[:, 0, 0]
    points = points[np.abs(points[:, 0, 1] - points[:, 1, 1]) >= 4][:256]
    angle = np.arange(_TURNS) * 2 * np.pi / _TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], -1), np.stack([np.sin(angle), np.cos(angle)], -1)], -2)
    return np.clip(np.rint(np.einsum("tij,pqj->tpqi", turn, points)), -PATCH, PATCH).astype(np.int64)


_TESTS = _pattern()
_YY, _XX = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
_DISC = _YY**2 + _XX**2 <= PATCH**2


def _blur(x: np.ndarray, times: int) -> np.ndarray:
    """Binomial smoothing of (n, h, w) images, edges repeated."""
    for _ in range(times):
        for axis in (1, 2):
            p = np.pad(x, [(1, 1) if a == axis else (0, 0) for a in range(3)], mode="edge")
            n = x.shape[axis]
            s = [np.take(p, range(k, k + n), axis=axis) for k in range(3)]
            x = (s[0] + 2 * s[1] + s[2]) / 4
    return x


def _resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resampling of (n, h, w) images."""
    ys = np.clip((np.arange(h) + 0.5) * x.shape[1] / h - 0.5, 0, x.shape[1] - 1)
    xs = np.clip((np.arange(w) + 0.5) * x.shape[2] / w - 0.5, 0, x.shape[2] - 1)
    y0, x0 = np.minimum(ys.astype(int), x.shape[1] - 2), np.minimum(xs.astype(int), x.shape[2] - 2)
    fy, fx = (ys - y0)[None, :, None], (xs - x0)[None, None, :]
    rows = x[:, y0] * (1 - fy) + x[:, y0 + 1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x0 + 1] * fx


def describe(images: np.ndarray) -> dict[str, np.ndarray]:
    """Corners of (n, h, w) grey images: image, x, y (of the full image), scale, angle, bits (k, 4) uint64."""
    out = defaultdict(list)
    n, h, w = images.shape
    for scale in SCALES:
        hs, ws = round(h * scale), round(w * scale)
        if min(hs, ws) < 2 * PATCH + 3:
            continue
        x = _blur(images if scale == 1 else _resize(images, hs, ws), 1)
        gy, gx = np.gradient(x, axis=(1, 2))
        a, b, c = (_blur(g, 2) for g in (gx * gx, gx * gy, gy * gy))
        corner = a * c - b * b - 0.05 * (a + c) ** 2
        best = corner.max(axis=(1, 2), keepdims=True)
        peak = (corner > CORNER_SHARE * best) & (best > 1e-9)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    near = np.roll(corner, (dy, dx), axis=(1, 2))
                    peak &= (corner > near) if (dy, dx) > (0, 0) else (corner >= near)
        peak[:, :PATCH] = peak[:, -PATCH:] = False
        peak[:, :, :PATCH] = peak[:, :, -PATCH:] = False
        i, py, px = np.nonzero(peak)
        smooth = _blur(x, 2)
        for s in range(0, len(i), 2048):
            ii, yy, xx = i[s : s + 2048], py[s : s + 2048], px[s : s + 2048]
            patch = smooth[ii[:, None, None], yy[:, None, None] + _YY, xx[:, None, None] + _XX] * _DISC
            angle = np.arctan2((patch * _YY).sum(axis=(1, 2)), (patch * _XX).sum(axis=(1, 2)))
            tests = _TESTS[np.rint(angle * _TURNS / (2 * np.pi)).astype(int) % _TURNS]
            at = [smooth[ii[:, None], yy[:, None] + tests[:, :, q, 1], xx[:, None] + tests[:, :, q, 0]] for q in (0, 1)]
            bits = np.packbits(at[0] < at[1], axis=1, bitorder="little").view(np.uint64)
            for k, v in zip(("image", "x", "y", "scale", "angle", "bits"), (ii, (xx + 0.5) * w / ws, (yy + 0.5) * h / hs, np.full(len(ii), scale), angle, bits)):
                out[k].append(v)
    if not out:
        return {k: np.zeros((0, 4) if k == "bits" else 0, np.uint64 if k == "bits" else np.int64 if k == "image" else float) for k in ("image", "x", "y", "scale", "angle", "bits")}
    return {k: np.concatenate(v) for k, v in out.items()}


def descriptors(images: DataFrame) -> DataFrame:
    """(image_id, spot, d0..d3) of (image_id, width, height, pixels): one byte a pixel, row by row.

    ``spot`` packs where a corner is and how it lies: x and y as shares of the longer
    side (18 bits each), that side's pixels at the corner's scale as 64ths of an
    octave (12), the angle in 4096ths of a turn (12).
    """
    names = ["image_id", "spot", "d0", "d1", "d2", "d3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, widths, heights, pixels = (b.column(i).to_pylist() for i in range(4))
            by_size: dict[tuple[int, int], list[int]] = defaultdict(list)
            for i, (w, h, p) in enumerate(zip(widths, heights, pixels)):
                if w and h and p is not None and len(p) == w * h:
                    by_size[h, w].append(i)
            for (h, w), rows in by_size.items():
                step = max(1, _IMAGES_AT_ONCE * 4096 // (h * w))
                for s in range(0, len(rows), step):
                    part = rows[s : s + step]
                    d = describe(np.frombuffer(b"".join(pixels[i] for i in part), np.uint8).reshape(len(part), h, w).astype(float))
                    if len(d["image"]) == 0:
                        continue
                    side = max(h, w)
                    x, y = (np.minimum((d[k] * (1 << 18) / side).astype(np.int64), (1 << 18) - 1) for k in ("x", "y"))
                    size = np.rint(np.log2(d["scale"] * side) * 64).astype(np.int64)
                    spot = (x << 42) | (y << 24) | (size << 12) | (np.rint(d["angle"] * 2048 / np.pi).astype(np.int64) & 4095)
                    bits = d["bits"].view(np.int64)
                    own = np.array([ids[i] for i in part], dtype=np.int64)[d["image"]]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(spot), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)]], names)

    rows = need(images, "image_id", "width", "height", "pixels").filter("image_id is not null and pixels is not null")
    return rows.mapInArrow(run, "image_id long, spot long, d0 long, d1 long, d2 long, d3 long")


def _inliers(a_spot: np.ndarray, b_spot: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Which matches, of rows of pairs padded to one length, agree on their pair's best motion from a to b."""
    part = lambda s, at, bits: ((s >> at) & ((1 << bits) - 1)).astype(float)
    a, b = ((part(s, 42, 18) + 1j * part(s, 24, 18)) / (1 << 18) for s in (a_spot, b_spot))
    la, lb = (part(s, 12, 12) / 64 for s in (a_spot, b_spot))
    motion = np.exp2(la - lb) * np.exp(2j * np.pi / 4096 * (part(b_spot, 0, 12) - part(a_spot, 0, 12)))
    slack = OFF_PIXELS * np.exp2(-lb)

    def alike(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        q = c / d
        return (np.abs(np.angle(q)) <= OFF_TURN) & (np.abs(np.log2(np.abs(q))) <= OFF_SCALE)

    # each match's motion, from its own corner on, against every match of the pair: [pair, motion, match]
    step = motion[:, :, None] * (a[:, None, :] - a[:, :, None])
    ok = np.abs(b[:, None, :] - b[:, :, None] - step) <= slack[:, None, :] + OFF_ONE * np.abs(step)
    ok &= alike(motion[:, None, :], motion[:, :, None]) & real[:, None, :] & real[:, :, None]
    inside = ok[np.arange(len(ok)), ok.sum(axis=2).argmax(axis=1)]
    for _ in range(3):
        n = np.maximum(inside.sum(axis=1), 1)
        ma, mb = ((v * inside).sum(axis=1) / n for v in (a, b))
        u, v = (a - ma[:, None]) * inside, (b - mb[:, None]) * inside
        c = (v * u.conj()).sum(axis=1) / np.maximum((np.abs(u) ** 2).sum(axis=1), 1e-12)
        c = np.where(np.abs(c) > 1e-6, c, 1e-6)
        far = np.abs(c[:, None] * (a - ma[:, None]))
        inside = (np.abs(b - mb[:, None] - c[:, None] * (a - ma[:, None])) <= slack + OFF_FITTED * far) & alike(motion, c[:, None]) & real
    return inside


def consensus(a: np.ndarray, b: np.ndarray, a_spot: np.ndarray, b_spot: np.ndarray, min_inliers: int) -> pa.RecordBatch:
    """(image_id, copy_id, inliers) of the pairs (in runs) whose matches agree on one motion from a to b.

    Inliers are counted by corners of the image that has fewer of them.
    """
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(a)))
    best = np.zeros(len(first), dtype=np.int64)
    width = 1 << np.maximum(np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64), 1)
    for w in np.unique(width[size >= min_inliers]).tolist():
        every = np.flatnonzero((width == w) & (size >= min_inliers))
        at_once = max(1, (1 << 20) // (w * w))
        for s in range(0, len(every), at_once):
            own = every[s : s + at_once]
            real = np.arange(w)[None, :] < size[own][:, None]
            at = first[own][:, None] + np.where(real, np.arange(w)[None, :], 0)
            inside = _inliers(a_spot[at], b_spot[at], real)
            row = np.nonzero(inside)[0]
            fewest = None
            for spot in (a_spot[at][inside], b_spot[at][inside]):
                order = np.lexsort((spot, row))
                fresh = np.append(True, (row[order][1:] != row[order][:-1]) | (spot[order][1:] != spot[order][:-1]))[: len(order)]
                count = np.bincount(row[order][fresh], minlength=len(own))
                fewest = count if fewest is None else np.minimum(fewest, count)
            best[own] = fewest
    good = best >= min_inliers
    return pa.RecordBatch.from_arrays([pa.array(a[first][good]), pa.array(b[first][good]), pa.array(best[good])], ["image_id", "copy_id", "inliers"])


def _word(t: int, prefix: str) -> Column:
    """Word ``t`` of a descriptor, which may lie across two of its longs."""
    k, s = divmod(t * WORD, 64)
    word = F.shiftrightunsigned(F.col(f"{prefix}d{k}"), s)
    if s + WORD > 64:
        word = word.bitwiseOR(F.shiftleft(F.col(f"{prefix}d{k + 1}"), 64 - s))
    return word.bitwiseAND(F.lit((1 << WORD) - 1))


def _whole(images: DataFrame) -> DataFrame:
    """The images that have an id and as many pixels as their sides say."""
    return need(images, "image_id", "width", "height", "pixels").filter("image_id is not null and pixels is not null and width > 0 and height > 0 and length(pixels) = width * height")


def find_copies(images: DataFrame, radius: int = RADIUS, min_inliers: int = MIN_INLIERS) -> DataFrame:
    """(image_id, copy_id, inliers, identical): pairs, image_id the smaller, of which one is a copy of the other.

    Images of equal size and pixels are ``identical`` and paired with the smallest
    id of their group; only that one is described and compared, so a pair of
    groups is reported by its smallest ids. ``inliers`` counts the corners that
    agree on the motion (for identical images it is null).

    Null ids, null pixels, and pixels that aren't width times height are left
    out; images without a corner, or too small for one, match nothing but
    identical ones. Of repeated rows of an id, all corners count. Corners that tie in
    strength are all kept; of equally good motions the first is taken. Images of any
    size are read whole. Other columns are ignored. No rows in, no rows out.

    The search is approximate (see the module's head): a match at the full radius is
    met with a probability of 0.93, and a copy needs ``min_inliers`` of its matches.
    """
    whole = _whole(images)
    prints = checkpointed(whole.select("image_id", F.xxhash64("width", "height", "pixels").alias("p0"), F.md5("pixels").alias("p1")))
    groups = prints.groupBy("p0", "p1").agg(F.min("image_id").alias("first"))
    same = prints.join(groups, ["p0", "p1"]).filter("image_id <> first").select(F.col("first").alias("image_id"), F.col("image_id").alias("copy_id"), F.lit(None).cast("long").alias("inliers"), F.lit(True).alias("identical")).distinct()
    firsts = groups.select(F.col("first").alias("image_id")).distinct()
    d = descriptors(whole.join(firsts, "image_id", "left_semi"))
    keys = F.array(*[(F.lit(t << WORD) + _word(t, "")).cast("int") for t in range(TABLES)])
    # both sides of the join read one exchange of slim rows
    keyed = d.withColumn("key", F.explode(keys)).repartition("key")
    columns = d.columns
    a = keyed.select("key", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = keyed.select("key", *[F.col(c).alias(f"b_{c}") for c in columns])
    apart = sum((F.bit_count(F.col(f"a_d{k}").bitwiseXOR(F.col(f"b_d{k}"))) for k in range(1, 4)), F.bit_count(F.col("a_d0").bitwiseXOR(F.col("b_d0"))))
    # a pair that meets in several tables counts in the first
    earlier = F.lit(False)
    for t in range(TABLES - 1):
        earlier = earlier | ((F.col("key") >= (t + 1) << WORD) & (_word(t, "a_") == _word(t, "b_")))
    met = a.join(b, "key").filter((F.col("a_image_id") < F.col("b_image_id")) & (apart <= radius) & ~earlier)
    pairs = met.select(F.col("a_image_id").alias("image_id"), F.col("b_image_id").alias("copy_id"), "a_spot", "b_spot").repartition("image_id", "copy_id").sortWithinPartitions("image_id", "copy_id")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if len(cols[0]) == 0:
                continue
            # the last pair may go on in the next batch
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            at = int(other[-1]) + 1 if len(other) else 0
            rest = [x[at:] for x in cols]
            if at:
                yield consensus(*(x[:at] for x in cols), min_inliers)
        if rest is not None:
            yield consensus(*rest, min_inliers)

    near = pairs.mapInArrow(vote, "image_id long, copy_id long, inliers long")
    return near.withColumn("identical", F.lit(False)).unionByName(same)


def copy_classes(images: DataFrame, **parameters) -> DataFrame:
    """(image_id, class_id, links), a row for each image: its class of copies, and how many other images it is paired with.

    Classes are the connected components of ``find_copies``' pairs, named by their
    smallest id; an image without a copy is alone in its own. ``links`` counts
    the images that are identical to it or a copy of it, and those identical to
    these: as many pairs as ``find_copies`` would have if identical images weren't
    folded. So the rows grow with the images, whatever the size of a class.

    What ``find_copies`` leaves out has no row. Repeated rows of an id are one
    image; an id of several pictures has the links of all of them.
    """
    pairs = checkpointed(find_copies(images, **parameters))
    classes = components(pairs.select(F.col("copy_id").alias("src"), F.col("image_id").alias("dst")))
    same = pairs.filter("identical").select("image_id", "copy_id")
    more = same.groupBy("image_id").agg(F.count("*").alias("n"))
    near = pairs.filter("not identical").select("image_id", "copy_id")
    both = near.unionByName(near.select(F.col("copy_id").alias("image_id"), F.col("image_id").alias("copy_id")))
    seen = both.join(more.select(F.col("image_id").alias("copy_id"), "n"), "copy_id", "left").select("image_id", (F.lit(1) + F.coalesce("n", F.lit(0))).alias("n"))
    first = seen.unionByName(more).groupBy("image_id").agg(F.sum("n").alias("n"))
    # an identical image sees what the first of its group sees, that one in its own stead
    links = first.unionByName(same.join(first, "image_id").select(F.col("copy_id").alias("image_id"), "n")).groupBy("image_id").agg(F.sum("n").alias("links"))
    every = _whole(images).select("image_id").distinct()
    found = every.join(classes, every["image_id"] == classes["node"], "left").drop("node").join(links, "image_id", "left")
    return found.select("image_id", F.coalesce("root", "image_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def embedding_thumbnails(embeddings: DataFrame, cell: int = 8) -> DataFrame:
    """Images (image_id, width, height, pixels) from vectors whose length is a square: each value a square of ``cell`` pixels, the range stretched to 0..255.

    Null vectors, vectors with a null and those of another length give no image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, px, side = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = int(len(v) ** 0.5) if v else 0
                if not v or k * k != len(v) or any(x is None for x in v):
                    continue
                m = np.array(v, dtype=float).reshape(k, k)
                m = (m - m.min()) / max(float(np.ptp(m)), 1e-12)
                ids.append(i)
                px.append(np.rint(np.kron(m, np.ones((cell, cell))) * 255).astype(np.uint8).tobytes())
                side.append(k * cell)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(side, pa.int32()), pa.array(side, pa.int32()), pa.array(px, pa.binary())], ["image_id", "width", "height", "pixels"])

    return need(embeddings, "vec_id", "embedding").mapInArrow(run, "image_id long, width int, height int, pixels binary")


def query(spark, sf_dir: str) -> DataFrame:
    """Classes of copies among the thumbnails of all embeddings (the test tables hold no other images)."""
    return copy_classes(embedding_thumbnails(table(spark, sf_dir, "embeddings")))
