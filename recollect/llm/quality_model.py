"""Quality classifier by co-training on two views of a document.

The content view holds the distinct words (hashed), the page-metadata view what
is known without reading: source, language, length and the layout (lines, word
length, shares of capitals, digits, signs and accents), each in coarse steps.
Each view trains a logistic regression on the labelled sample. In each round
both score every unlabelled document of the corpus, and each hands those it is
surest of, up to ``HAND_OVER`` in the proportion of the classes, to the other's
training set with its own label. What a pseudo-label says counts less than a
label (``PSEUDO_WEIGHT``), and what a feature says is read from it only where the
labels hardly know the feature.

The labelled sample is split in three: the regressions' rows, those that tell
how sure a view is, and those that calibrate the two views and their
combination. When that is done, both views are fitted once more on all labels
and what they were handed.

Only the fit uses samples, bounded by ``LABELLED`` labels and ``HAND_OVER``
pseudo-labels a view and round, picked from all documents; every document is
scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.arrow_text import mix64, slices, utf8
from recollect.llm.common import need, table
from recollect.llm.simhash import distinct_features

#: Bounds of the fit: labelled documents, the first in order of a hash of doc_id, and pseudo-labels a view and round.
LABELLED = 12000
HAND_OVER = 1000
ROUNDS = 3
STEPS = 120
#: Least probability, by the view's own calibration, for a pseudo-label; and what it counts beside a label.
CERTAIN = 0.95
PSEUDO_WEIGHT = 0.25
#: Least share of right ones among the judging labels of which a view is as certain, one right and one wrong added; below, it hands none of that class.
TRUSTED = 0.93
#: Shares of the labels that judge a view's certainty and that calibrate.
JUDGE, CALIBRATE = 0.2, 0.2
#: A feature speaks if its log-odds are so many standard errors from nought; on fewer labelled rows than RARE it is learnt from pseudo-labels, too.
TELLING = (3.5, 2.0)
RARE = 5
THRESHOLD = 0.5

WORD_BITS = 16
META_BITS = 10
_META_FIELDS = 10

_KIND = np.zeros((5, 256), dtype=bool)
_KIND[0, [10]] = True  # lines
_KIND[1, 65:91] = True  # capitals
_KIND[2, 48:58] = True  # digits
_KIND[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # signs
_KIND[4, 194:245] = True  # first bytes of accented letters and the like


@dataclass
class View:
    """Sparse rows: feature ids and where each row's begin (with the end)."""

    ids: np.ndarray
    at: np.ndarray

    def take(self, rows: np.ndarray) -> "View":
        n = (self.at[1:] - self.at[:-1])[rows]
        upto = np.append(0, np.cumsum(n))
        return View(self.ids[np.arange(int(upto[-1])) + np.repeat(self.at[rows] - upto[:-1], n)], upto)

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Sum of the weights of each row's features."""
        n = self.at[1:] - self.at[:-1]
        return np.bincount(np.repeat(np.arange(len(n)), n), weights=weight[self.ids], minlength=len(n))  # row by row: the same whatever the other rows

    def __add__(self, other: "View") -> "View":
        return View(np.concatenate([self.ids, other.ids]), np.concatenate([self.at, other.at[1:] + self.at[-1]]))


def _field_hash(values: list[str | None], field: int) -> np.ndarray:
    import zlib

    known: dict[str | None, int] = {}
    for v in values:
        if v not in known:
            known[v] = zlib.crc32(f"{field}|{'' if v is None else '=' + v}".encode("utf-8", "surrogatepass")) & ((1 << META_BITS) - 1)
    return np.array([known[v] for v in values], dtype=np.int64)


def content_view(text: pa.Array) -> View:
    features, n = distinct_features(text, pairs=False)
    return View((features >> np.uint64(44 - WORD_BITS)).astype(np.int64), np.append(0, np.cumsum(n)))


def metadata_view(source: list, lang: list, text: pa.Array) -> View:
    raw, at = utf8(text)
    n = len(at) - 1
    size = np.diff(at)
    counts = []
    for kind in _KIND:
        total = np.append(0, np.cumsum(kind[raw], dtype=np.int64))
        counts.append(total[at[1:]] - total[at[:-1]])
    blank = np.append(0, np.cumsum((raw == 32) | (raw == 10), dtype=np.int64))
    words = blank[at[1:]] - blank[at[:-1]] + 1
    share = lambda x: np.ceil(np.sqrt(x / np.maximum(size, 1)) * 16)
    numbers = [np.floor(np.log2(np.maximum(size, 1))), np.floor(2 * np.log2(size / (counts[0] + 1) + 1)), np.minimum(np.floor(size / words), 40), *[share(c) for c in counts]]
    cols = [_field_hash(source, 0), _field_hash(lang, 1)]
    for k, v in enumerate(numbers, 2):
        cols.append((mix64((v.astype(np.int64) + 64).astype(np.uint64) + np.uint64(1000 * k)) & np.uint64((1 << META_BITS) - 1)).astype(np.int64))
    return View(np.stack(cols, axis=1).ravel(), np.arange(n + 1) * _META_FIELDS)


def fit(view: View, y: np.ndarray, size: int, labels: int | None = None, telling: float = TELLING[0], steps: int = STEPS, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by their naive Bayes log-odds, by full-batch Adagrad; deterministic.

    The first ``labels`` rows (by default all) are labelled, the others pseudo-labelled.
    Features that don't tell the classes apart by ``telling`` standard errors are left
    out, so that hundreds of common words can't outweigh a few telling ones.
    """
    labels = len(y) if labels is None else labels
    n = view.at[1:] - view.at[:-1]
    row = np.repeat(np.arange(len(y)), n)
    cut = int(view.at[labels])
    own, more = view.ids[:cut], view.ids[cut:]
    count = np.bincount(own, minlength=size).astype(float)
    good = np.bincount(own, weights=y[row[:cut]], minlength=size)
    rare = count < RARE
    count += np.where(rare, np.bincount(more, minlength=size), 0)
    good += np.where(rare, np.bincount(more, weights=y[row[cut:]], minlength=size), 0)
    bad = count - good
    yes, no = ([(y[:labels] == c).sum() + np.where(rare, (y[labels:] == c).sum(), 0) for c in (1, 0)])
    odds = np.log((good + 0.5) / (yes + 1)) - np.log((bad + 0.5) / (no + 1))
    # twice the log-likelihood ratio of the feature's own share of good rows to the share of all
    share = yes / np.maximum(yes + no, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = 2 * (np.where(good > 0, good * np.log(good / (count * share)), 0) + np.where(bad > 0, bad * np.log(bad / (count * (1 - share))), 0))
    odds[~(surprise >= telling**2)] = 0
    use = np.flatnonzero(odds[view.ids])
    ids, row = view.ids[use], row[use]
    x, at = odds[ids], np.searchsorted(row, np.arange(len(y) + 1))
    weight = np.where(np.arange(len(y)) < labels, 1.0, PSEUDO_WEIGHT)
    weight /= max(weight.sum(), 1e-9)
    w, b = np.zeros(size), 0.0
    gw, gb = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        z = np.append(0.0, np.cumsum(w[ids] * x))
        err = weight * (1 / (1 + np.exp(-np.clip(z[at[1:]] - z[at[:-1]] + b, -30, 30))) - y)
        grad = np.bincount(ids, err[row] * x, minlength=size) + ridge * w
        gw += grad * grad
        w -= 0.5 * grad / np.sqrt(gw)
        g = err.sum()
        gb += g * g
        b -= 0.5 * g / np.sqrt(gb)
    return w * odds, float(b)


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    """Coefficients and intercept that turn log-odds (one or more columns) into calibrated log-odds: Newton with a little ridge."""
    x = np.column_stack([x, np.ones(len(y))])
    beta = np.zeros(x.shape[1])
    beta[:-1] = 1.0 / max(x.shape[1] - 1, 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        move = np.linalg.solve(h, x.T @ (p - y) + 1e-2 * (beta - np.append(np.full(len(beta) - 1, 1.0 / max(len(beta) - 1, 1)), 0.0)))
        beta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return beta


@dataclass
class Model:
    content: tuple[np.ndarray, float]
    metadata: tuple[np.ndarray, float]
    content_fit: np.ndarray
    metadata_fit: np.ndarray
    combined: np.ndarray
    #: Pseudo-labels that content and metadata handed over, round by round.
    handed: list[tuple[int, int]] = field(default_factory=list)

    def logits(self, a: View, b: View) -> np.ndarray:
        """Calibrated log-odds (content, metadata) a row."""
        return np.stack([c[0] * (v.sums(w) + bias) + c[1] for (w, bias), v, c in ((self.content, a, self.content_fit), (self.metadata, b, self.metadata_fit))], axis=1)

    def score(self, a: View, b: View) -> np.ndarray:
        """Probabilities (content, metadata, combined) a row."""
        x = self.logits(a, b)
        z = np.column_stack([x, x @ self.combined[:2] + self.combined[2]])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_SIZES = (1 << WORD_BITS, 1 << META_BITS)


class Sample:
    """The rows that the views are fitted on: labelled ones, and what each view was handed."""

    def __init__(self, views: tuple[View, View], y: np.ndarray):
        """Rows with ``y`` 0 or 1, in a random, fixed order."""
        self.views, self.y = views, y
        n = len(y)
        cuts = [n - int(n * (JUDGE + CALIBRATE)), n - int(n * CALIBRATE)]
        self.train, self.judge, self.calibrate = np.split(np.arange(n), cuts)
        none = np.zeros(0, np.int64)
        self.more = [(View(none, np.zeros(1, np.int64)), np.zeros(0)) for _ in views]

    def fit(self, rows: np.ndarray) -> list[tuple[np.ndarray, float]]:
        """Both views on these labelled rows and what they were handed."""
        return [fit(v.take(rows) + m, np.append(self.y[rows].astype(float), t), s, len(rows), z) for v, (m, t), s, z in zip(self.views, self.more, _SIZES, TELLING)]

    def model(self, rows: np.ndarray, judge: np.ndarray) -> Model:
        """Fitted on ``rows``, calibrated on ``judge``."""
        views = self.fit(rows)
        z = [v.take(judge).sums(w) + b for v, (w, b) in zip(self.views, views)]
        own = [calibrate(x[:, None], self.y[judge]) for x in z]
        return Model(*views, *own, calibrate(np.stack([c[0] * x + c[1] for x, c in zip(z, own)], axis=1), self.y[judge]))

    def hand(self, view: int, rows: View, labels: np.ndarray) -> None:
        """Put pseudo-labelled rows into a view's training set."""
        m, t = self.more[view]
        self.more[view] = (m + rows, np.append(t, labels))

    def quota(self, model: Model, hand_over: int, certain: float) -> list[list[int]]:
        """Most pseudo-labels of classes 0 and 1 that each view may hand over: none where its certainty doesn't hold on the judging labels."""
        p = 1 / (1 + np.exp(-model.logits(*(v.take(self.judge) for v in self.views))))
        y, share = self.y[self.judge], float(self.y.mean())
        out = []
        for view in range(2):
            sure = [(p[:, view] if c else 1 - p[:, view]) >= certain for c in (0, 1)]
            right = [((y[s] == c).sum() + 1) / (s.sum() + 2) for c, s in enumerate(sure)]
            out.append([round(hand_over * (share if c else 1 - share)) if right[c] >= TRUSTED else 0 for c in (0, 1)])
        return out

    def finish(self) -> Model:
        """Calibrated on labels kept apart, then fitted on all labels."""
        model = self.model(np.append(self.train, self.judge), self.calibrate)
        model.content, model.metadata = self.fit(np.arange(len(self.y)))
        return model


def labels_of(labels: DataFrame) -> DataFrame:
    """(doc_id, good): good is quality 1 and not toxic. Of several rows of an id the worst counts; rows with a null are no labels."""
    rows = need(labels, "doc_id", "quality", "toxic").filter("doc_id is not null and quality is not null and toxic is not null")
    return rows.groupBy("doc_id").agg(F.min(F.when((F.col("quality") >= 1) & (F.col("toxic") <= 0), 1).otherwise(0)).alias("good"))


def _views(b: pa.RecordBatch) -> tuple[View, View]:
    return content_view(b.column("text")), metadata_view(b.column("source").to_pylist(), b.column("lang").to_pylist(), b.column("text"))


def _features(docs: DataFrame, ids: list[int]) -> tuple[np.ndarray, tuple[View, View]]:
    """Ids and views of the documents named, one row an id (of repeated ids the text with the least hash), in order of the id."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                lists = [pa.ListArray.from_arrays(pa.array(v.at.astype(np.int32)), pa.array(v.ids.astype(np.int32))) for v in _views(b)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *lists], ["doc_id", "content", "metadata"])

    picked = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = need(docs, "doc_id", "text", "source", "lang").join(F.broadcast(picked), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64("source", "lang"))
    rows = rows.withColumn("nr", F.row_number().over(first)).filter("nr = 1").select("doc_id", "text", "source", "lang")
    out = rows.mapInArrow(run, "doc_id long, content array<int>, metadata array<int>").toArrow()
    own = out["doc_id"].to_numpy()
    order = np.argsort(own, kind="stable")
    views = []
    for name in ("content", "metadata"):
        col = out[name].combine_chunks()
        views.append(View(col.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(col.value_lengths().to_numpy()))).take(order))
    return own[order], (views[0], views[1])


def surest(docs: DataFrame, known: DataFrame, model: Model, taken: list[tuple[int, int]], quota: list[list[int]], certain: float = CERTAIN) -> DataFrame:
    """(doc_id, view, good): what each view is surest of among all documents without a label.

    ``known`` has the labelled doc_ids, ``taken`` (doc_id, view) what a view handed
    over before, ``quota`` the most documents of each view's classes 0 and 1. Of rows that share
    an id the surest counts; ties go by a hash of the id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in slices(whole, "text"):
                p = 1 / (1 + np.exp(-np.clip(m.logits(*_views(b)), -30, 30)))
                row, view = np.nonzero(np.maximum(p, 1 - p) >= certain)
                q = p[row, view]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array(view.astype(np.int32)), pa.array((q >= 0.5).astype(np.int32)), pa.array(np.maximum(q, 1 - q))], ["doc_id", "view", "good", "sure"])

    sure = need(docs, "doc_id", "text", "source", "lang").filter("doc_id is not null").mapInArrow(run, "doc_id long, view int, good int, sure double")
    sure = sure.groupBy("doc_id", "view").agg(F.max(F.struct("sure", "good")).alias("s")).select("doc_id", "view", "s.good", "s.sure").join(known.select("doc_id"), "doc_id", "left_anti")
    before = docs.sparkSession.createDataFrame(taken, "doc_id long, view int")
    sure = sure.join(F.broadcast(before), ["doc_id", "view"], "left_anti")
    best = Window.partitionBy("view", "good").orderBy(F.desc("sure"), F.xxhash64("doc_id"), "doc_id")
    most = F.element_at(F.array(*[F.lit(n) for v in quota for n in v]), F.col("view") * 2 + F.col("good") + 1)
    return sure.withColumn("nr", F.row_number().over(best)).filter(F.col("nr") <= max(map(max, quota))).filter(F.col("nr") <= most).select("doc_id", "view", "good")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, hand_over: int = HAND_OVER, rounds: int = ROUNDS, certain: float = CERTAIN) -> Model | None:
    """Co-train on at most ``labelled`` labels and ``hand_over`` pseudo-labels a view and round; None if there are not both classes.

    Ties in the order of documents are broken by the id. Repeated rows of an id are
    one document, so both bounds hold whatever the rows.
    """
    good = labels_of(labels)
    ids = need(docs, "doc_id").filter("doc_id is not null").distinct()
    picked = dict(ids.join(good, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect())
    if len(picked) < 20 or len(set(picked.values())) < 2:
        return None
    own, views = _features(docs, list(picked))
    y = np.array([picked[i] for i in own.tolist()])
    order = np.lexsort((own, mix64(own.view(np.uint64))))
    sample = Sample((views[0].take(order), views[1].take(order)), y[order])
    if any(len(set(sample.y[rows].tolist())) < 2 for rows in (sample.train, sample.judge, sample.calibrate)):
        return None
    handed, taken = [], []
    for _ in range(rounds):
        model = sample.model(sample.train, sample.judge)
        quota = sample.quota(model, hand_over, certain)
        rows = surest(docs, good, model, taken, quota, certain).collect() if any(map(any, quota)) else []
        if not rows:
            break
        found, views = _features(docs, sorted({r["doc_id"] for r in rows}))
        at = {i: k for k, i in enumerate(found.tolist())}
        for k in (0, 1):
            given = sorted((r["doc_id"], r["good"]) for r in rows if r["view"] == k)
            where = np.array([at[i] for i, _ in given], dtype=np.int64)
            sample.hand(1 - k, views[1 - k].take(where), np.array([g for _, g in given], dtype=float))
        taken += [(r["doc_id"], r["view"]) for r in rows]
        handed.append(tuple(sum(r["view"] == k for r in rows) for k in (0, 1)))
    model = sample.finish()
    model.handed = handed
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, content_score, metadata_score, score, keep) of every row.

    Null and empty texts have no content (the intercept alone speaks); a null
    source or language is a value of its own. A null ``doc_id`` is carried along,
    repeated rows get equal scores, long texts are read whole, other columns are
    ignored. Without a model (labels of one class or none) scores are null and
    every document is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "content_score", "metadata_score", "score", "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in slices(whole, "text"):
                ident = b.column("doc_id").cast(pa.int64())
                if m is None:
                    none = pa.nulls(b.num_rows, pa.float64())
                    yield pa.RecordBatch.from_arrays([ident, none, none, none, pa.array(np.ones(b.num_rows, bool))], names)
                    continue
                p = m.score(*_views(b))
                yield pa.RecordBatch.from_arrays([ident, *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(3)], pa.array(p[:, 2] >= threshold)], names)

    return need(docs, "doc_id", "text", "source", "lang").mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, hand_over: int = HAND_OVER, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``; see ``train`` and ``score``."""
    return score(docs, train(docs, labels, labelled, hand_over, rounds), threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
