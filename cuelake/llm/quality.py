"""Quality classifier by co-training on two views of a document.

The text view counts hashed words and word endings of the whole text.  The
metadata view has what is known about the page: language, source, size, line
layout and shares of character classes.  Each view has its own logistic
regression, first fitted on labelled rows.  In each round a pass over all
documents lets both views label what they are confident about, and each view
learns from the other's labels: every task takes gradient steps over its
blocks, and the tasks' weights are averaged by their numbers of rows.  A fit on
the labelled rows, drawn to that average, ends the round.  Both views are
calibrated on labelled rows that no fit trains on, and a blend of the
calibrated log-odds, fitted on those rows too, scores every document.

The fit on labelled rows takes at most MAX_LABELLED of them, the first by a
hash of the id; the bound is a parameter.  Pseudo-labels come from all rows
and whole texts, and so do scores; neither pass shuffles a text.

Defined cases: a null text counts as empty; an empty text has zero features and gets
the score of its metadata and the intercepts; null language or source is a
value of its own; null sizes are taken from the text; rows that repeat an id
are scored alike if they are equal, and only one of them trains; labels that
contradict each other count as their smallest; if one class has no labels,
every score is the share of class 1 (1 without labels).  A very long text is
a block of its own.  An empty table gives an empty result.  Other columns are
ignored or, in ``keep_good``, pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblock as tb
from .common import Scratch

MAX_LABELLED = 6000
ROUNDS = 3
CONFIDENT = 0.95
#: Gradient steps over each block of pseudo-labelled rows, and how strongly the labelled fit is drawn to what they give.
POOL_STEPS, PULL = 5, 1e-3
#: Rows that are held as a dense matrix at once.
DENSE_ROWS = 512
#: Documents below this score are rejected.
MIN_SCORE = 0.5
WORDS = ENDINGS = 512
#: Shares of words that repeat the word before, in three steps.
REPEATS = 3
TEXT_DIMS = WORDS + ENDINGS + REPEATS
META_DIMS = 12 + 16 + 64
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_CLASS[tb._SPACE] = 4


def _text_terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the text view: shares of hashed words and endings."""
    words = tb.Words(raw, off)
    rows = len(off) - 1
    share = 1 / np.maximum(np.diff(words.first), 1)
    tail = np.zeros(len(words.end), np.uint64)
    for k in (1, 2, 3):
        at = words.end - k
        tail = tail << np.uint64(8) | np.where(at >= words.start, raw[np.maximum(at, 0)], 0).astype(np.uint64)
    ending = (tb.mix64(tail + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64) + WORDS
    word = (words.hash % np.uint64(WORDS)).astype(np.int64)
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    same = np.bincount(words.doc[again], minlength=rows) * share
    steps = np.stack([same, same > 0.1, same > 0.4], axis=1)
    row = np.concatenate([words.doc, words.doc])
    value = np.concatenate([10 * share[row], 2.0 * steps.ravel()])
    at = WORDS + ENDINGS + np.arange(REPEATS)
    return np.concatenate([row, np.repeat(np.arange(rows), REPEATS)]), np.concatenate([word, ending, np.tile(at, rows)]), value


def _meta_matrix(raw: np.ndarray, off: np.ndarray, lang: list, source: list, n_chars: list) -> np.ndarray:
    rows = len(off) - 1
    out = np.zeros((rows, META_DIMS), np.float32)
    size = np.diff(off)
    row = np.repeat(np.arange(rows), size)
    kinds = np.bincount(row * 5 + _CLASS[raw], minlength=rows * 5).reshape(rows, 5) / np.maximum(size, 1)[:, None]
    feeds = np.bincount(row[raw == 10], minlength=rows)
    given = np.array([s if n is None else n for n, s in zip(n_chars, size, strict=True)], float)
    high = np.bincount(row[raw >= 128], minlength=rows) / np.maximum(size, 1)
    twice = np.zeros(len(raw), bool)
    twice[1:] = (raw[1:] == raw[:-1]) & (_CLASS[raw[1:]] == 3)
    out[:, 0] = np.log1p(np.maximum(given, 0)) / 5
    out[:, 1] = np.log1p(feeds) / 3
    out[:, 2] = np.log1p(size / (feeds + 1)) / 5
    out[:, 3:7] = kinds[:, 1:] * 4
    out[:, 7] = high * 4
    out[:, 8] = np.bincount(row[twice], minlength=rows) / np.maximum(size, 1) * 10
    out[:, 9] = kinds[:, 3] > 0.05
    out[:, 10] = kinds[:, 1] > 0.3
    out[:, 11] = size == 0
    for values, base, dims in ((lang, 12, 16), (source, 28, 64)):
        code = tb.span_hash(*_spelled(values))
        out[np.arange(rows), base + (code % np.uint64(dims)).astype(np.int64)] = 1
    return out


def _spelled(values: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [b"\x00" if v is None else b"=" + str(v).encode() for v in values]
    ends = np.cumsum([len(x) for x in raw]) if raw else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _views(batch: pa.RecordBatch):
    """(rows, text terms, metadata matrix) of blocks of a batch (doc_id, text, lang, source, n_chars)."""
    for first, end, raw, off in tb.blocks(batch.column(1)):
        lang, source, n_chars = (batch.column(k).slice(first, end - first).to_pylist() for k in (2, 3, 4))
        yield first, end, _text_terms(raw, off), _meta_matrix(raw, off, lang, source, n_chars)


def _dense(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, text matrix, metadata matrix) of runs of at most DENSE_ROWS rows."""
    for first, end, (row, feature, value), meta in _views(batch):
        for lo in range(0, end - first, DENSE_ROWS):
            hi = min(lo + DENSE_ROWS, end - first)
            part = (row >= lo) & (row < hi)
            text = np.bincount((row[part] - lo) * TEXT_DIMS + feature[part], value[part], (hi - lo) * TEXT_DIMS).astype(np.float32)
            yield first + lo, first + hi, text.reshape(hi - lo, TEXT_DIMS), meta[lo:hi]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dense features of the bounded labelled sample, with its labels (column 5)."""
    for batch in batches:
        for first, end, *views in _dense(batch):
            both = [pa.array([x.tobytes() for x in m], pa.binary()) for m in views]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(5).slice(first, end - first), *both], ["doc_id", "label", "text", "meta"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Logistic:
    """Weights and intercept by Adam; both classes weigh the same."""

    def __init__(self, dims: int, start: tuple[np.ndarray, float] | None = None, rate: float = 0.05):
        self.w, self.b = (np.zeros(dims), 0.0) if start is None else (start[0].copy(), start[1])
        self.m, self.v, self.t, self.rate = np.zeros(dims + 1), np.zeros(dims + 1), 0, rate

    def step(self, x: np.ndarray, y: np.ndarray, decay: float = 1e-4, pull: float = 0.0, to: np.ndarray | None = None) -> None:
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        miss = (_sigmoid(x @ self.w.astype(np.float32) + self.b) - y) * weight
        g = np.append(miss.astype(np.float32) @ x + decay * self.w + (pull * (self.w - to) if to is not None else 0), miss.sum())
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        move = self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
        self.w, self.b = self.w - move[:-1], self.b - float(move[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, start: tuple[np.ndarray, float] | None = None, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept on all rows at once, drawn to ``start`` if given."""
    x, model = x.astype(np.float32, copy=False), _Logistic(x.shape[1], start)
    for _ in range(steps):
        model.step(x, y, pull=PULL, to=None if start is None else start[0])
    return model.w, model.b


def calibrate(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt scaling: slopes of the columns of ``margins`` and a shift, by Newton steps with softened targets."""
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([margins, np.ones(len(y))])
    theta = np.append(np.full(x.shape[1] - 1, 0.5), 0.0)
    for _ in range(50):
        p = _sigmoid(x @ theta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(theta))
        theta = theta - np.clip(np.linalg.solve(h, x.T @ (p - goal) + 1e-3 * theta), -1, 1)
    return theta


def fit_labelled(text: np.ndarray, meta: np.ndarray, label: np.ndarray, held: np.ndarray, start: list | None = None) -> dict:
    """Both views' weights on the labelled rows, calibrated and blended on those that ``held`` marks."""
    if len(np.unique(label[~held])) < 2 or len(np.unique(label[held])) < 2:
        share = float(label.mean()) if len(label) else 1.0
        return {"constant": min(max(share, 0.0), 1.0)}
    views = [text, meta]
    models = [fit_logistic(x[~held], label[~held].astype(float), None if start is None else start[k]) for k, x in enumerate(views)]
    y = label[held].astype(float)
    margins = [x[held] @ w + b for x, (w, b) in zip(views, models, strict=True)]
    scale = [calibrate(m, y) for m in margins]
    odds = np.column_stack([s * m + t for m, (s, t) in zip(margins, scale, strict=True)])
    return {"models": models, "scale": scale, "blend": calibrate(odds, y)}


def _fit(start: list | None):
    """One row (model): the fit on all rows of the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for batch in batches for x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
        rows.sort(key=lambda r: r[0])
        text, meta = (np.frombuffer(b"".join(r[k] for r in rows), np.float32).reshape(len(rows), dims) for k, dims in ((2, TEXT_DIMS), (3, META_DIMS)))
        label = np.array([r[1] for r in rows], np.int64)
        held = tb.mix64(np.array([r[0] for r in rows], np.int64).view(np.uint64)) % np.uint64(5) == 0
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_labelled(text, meta, label, held, start))], pa.binary())], ["model"])

    return run


def _exchange(models: Broadcast):
    """(view, place, total): over a task's rows, each view's weights after steps on the other's confident labels, times their number; the intercept comes last, then the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = models.value
        own, count = [_Logistic(len(w), (w, b), 0.01) for w, b in given], [0, 0]
        for batch in batches:
            for _, _, *views in _dense(batch):
                chance = [_sigmoid(x @ w + b) for x, (w, b) in zip(views, given, strict=True)]
                for k in (0, 1):
                    p = chance[1 - k]
                    sure = np.maximum(p, 1 - p) >= CONFIDENT
                    if sure.any():
                        x, y = views[k][sure], (p[sure] >= 0.5).astype(float)
                        for _ in range(POOL_STEPS):
                            own[k].step(x, y)
                        count[k] += int(sure.sum())
        total = [np.append(np.append(m.w, m.b) * n, n) for m, n in zip(own, count, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], [len(t) for t in total])), pa.array(np.concatenate([np.arange(len(t)) for t in total])), pa.array(np.concatenate(total).astype(float))], ["view", "place", "total"]
        )

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> dict:
    """The model from ``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id, quality)."""
    scratch = Scratch(spark, "quality")
    rows = _columns(docs)
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    ids = marks.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = scratch.store(ids.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(max_labelled), "chosen")
    # At most max_labelled ids.
    sample = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", "source", "n_chars", "label").dropDuplicates(["doc_id"])
    sample = scratch.store(sample.mapInArrow(_features, "doc_id long, label int, text binary, meta binary"), "sample")

    def labelled(start: list | None) -> dict:
        # The sample is bounded by its parameter, so one task holds it.
        found = sample.coalesce(1).mapInArrow(_fit(start), "model binary").first()
        return {"constant": 1.0} if found is None else pickle.loads(found.model)

    model = labelled(None)
    for _ in range(rounds):
        if "constant" in model:
            break
        parts = rows.mapInArrow(_exchange(spark.sparkContext.broadcast(model["models"])), "view long, place long, total double")
        # A fixed number of rows, one a weight.
        sums = [np.array([r.total for r in part]) for part in _by_view(parts.groupBy("view", "place").agg(F.sum("total").alias("total")).collect())]
        start = [(x[:-2] / x[-1], float(x[-2] / x[-1])) if len(x) and x[-1] > 0 else m for x, m in zip(sums, model["models"], strict=True)]
        model = labelled(start)
    return model


def _by_view(rows: list) -> list[list]:
    return [sorted((r for r in rows if r.view == k), key=lambda r: r.place) for k in (0, 1)]


def _columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    lack = F.lit(None)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *((F.col(c) if c in have else lack).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long")))
    )


def _scorer(model):
    def run(batch: pa.RecordBatch) -> list[np.ndarray]:
        """Calibrated scores of the text view, the metadata view and both."""
        fitted, parts = model.value, [[], [], []]
        for first, end, (row, feature, value), meta in _views(batch):
            n = end - first
            if "constant" in fitted:
                for p in parts:
                    p.append(np.full(n, fitted["constant"]))
                continue
            (w, b), (w2, b2) = fitted["models"]
            margins = [np.bincount(row, value * w[feature], n) + b, meta @ w2 + b2]
            odds = [s * m + t for m, (s, t) in zip(margins, fitted["scale"], strict=True)]
            u, v, shift = fitted["blend"]
            for p, o in zip(parts, (*odds, u * odds[0] + v * odds[1] + shift), strict=True):
                p.append(_sigmoid(o))
        return [np.concatenate(p) if p else np.zeros(0) for p in parts]

    return run


def score(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text_score, meta_score, score for each row of ``docs``; scores are the chance of quality 1."""
    run = _scorer(spark.sparkContext.broadcast(model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, run(batch))], ["doc_id", "text_score", "meta_score", "score"])

    return _columns(docs).mapInArrow(scored, "doc_id long, text_score double, meta_score double, score double")


def keep_good(spark: SparkSession, docs: DataFrame, model: dict, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``min_score``."""
    run, names = _scorer(spark.sparkContext.broadcast(model)), docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    view = _columns(docs).columns
    place = [names.index(v) if v in names else None for v in view]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.nulls(batch.num_rows, t) if i is None else batch.column(i).cast(t) for i, t in zip(place, types, strict=True)]
            yield batch.filter(pa.array(run(pa.RecordBatch.from_arrays(columns, view))[2] >= min_score))

    return plain.mapInArrow(good, plain.schema).toDF(*names)
