"""Quality classifier: naive Bayes support vectors.

n-gram indicators of a text (words, word pairs, and one to three word shapes; hashed) are scaled by the log-count
ratio of the two classes, brought to length 1, and given to a linear hinge-loss model that dual coordinate
descent fits. A logistic curve over margins of rows kept out of the fit turns margins into scores.

The fit uses a bounded sample: the ``TRAIN_ROWS`` labelled training rows of lowest seeded hash (a documented
parameter; the same at every corpus size). Their hashed features, not their texts, come to the driver
(8,000 rows of some thousand integers). Scoring covers every row: the model (two float32 vectors of
``BUCKETS``) is broadcast, and tasks score Arrow batches. Only texts and quality labels enter the model.

Edge cases: a null or empty text has no features and gets the score of the model's intercept; without rows of
both classes every score is the share of good rows (0.5 if there are none); repeated labels of a document count
once; repeated documents are scored each; an empty table gives no rows; other columns are not read. Texts are
used whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_mod

BUCKETS = 1 << 18
TRAIN_ROWS = 8_000
CACHED_WORDS = 300_000
_SHAPES = ((re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_a]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1\1"))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def shape(word: str) -> str:
    """A word with its runs of letters, digits and repeated signs drawn together."""
    first = "A" if word[:1].isupper() else ""
    for pattern, by in _SHAPES:
        word = pattern.sub(by, word)
    return first + word[:12]


class Features:
    """Sorted distinct buckets of a text's n-grams; word hashes are cached up to a bound."""

    def __init__(self):
        self.seen: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        ws, seen = (text or "").split(), self.seen
        if not ws:
            return np.empty(0, np.int32)
        if len(seen) > CACHED_WORDS:
            seen.clear()
        for w in set(ws):
            if w not in seen:
                seen[w] = _hash(w.lower()), _hash("shape " + shape(w))
        both = np.array([seen[w] for w in ws], np.uint64)
        h, s = both[:, 0], both[:, 1].copy()
        s[1:][h[1:] == h[:-1]] = np.uint64(12345)  # a word said again
        found = [h, s, h[:-1] * np.uint64(31) + h[1:], s[:-1] * np.uint64(33) + s[1:], s[:-2] * np.uint64(1089) + s[1:-1] * np.uint64(35) + s[2:]]
        x = np.concatenate(found)
        x = (x ^ (x >> np.uint64(29))) * _PRIME
        return np.unique((x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Of each bucket: log of its share among good rows over its share among others."""
    counts = np.full((2, BUCKETS), smoothing)
    for x, y in zip(rows, labels, strict=True):
        counts[int(y), x] += 1
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, passes: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and intercept over rows of scaled indicators of length 1."""
    w, b = np.zeros(len(scale)), 0.0
    signs, alpha, order = np.where(labels == 1, 1.0, -1.0), np.zeros(len(rows)), np.random.default_rng(seed)
    values = [scale[x] / max(np.sqrt((scale[x] ** 2).sum()), 1e-9) for x in rows]
    upper = cost * np.where(labels == 1, len(labels) / max(2 * (labels == 1).sum(), 1), len(labels) / max(2 * (labels == 0).sum(), 1))
    for _ in range(passes):
        most = 0.0
        for i in order.permutation(len(rows)):
            x, v, y = rows[i], values[i], signs[i]
            gradient = y * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), upper[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[x] += step * y * v
                b += step * y
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, b


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton's method with smoothed targets)."""
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, p = np.stack([margins, np.ones(len(margins))], 1), np.array([2.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - q) - 1e-3 * p)
        p = p + step
        if abs(step).max() < 1e-6:
            break
    return float(p[0]), float(p[1])


class Model:
    """score = logistic(slope * margin + offset)."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray, intercept: float, curve: tuple[float, float]):
        self.weights, self.scale, self.intercept, self.curve = weights.astype(np.float32), (scale**2).astype(np.float32), intercept, curve

    def score(self, x: np.ndarray) -> float:
        margin = self.intercept
        if len(x):
            margin += float(self.weights[x].sum(dtype=np.float64) / max(np.sqrt(self.scale[x].sum(dtype=np.float64)), 1e-9))
        return float(1 / (1 + np.exp(-min(max(self.curve[0] * margin + self.curve[1], -30), 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled documents, those of lowest hash of the id."""
    picked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    picked = picked.orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([of(t.as_py()) for t in batch.column(2)], pa.list_(pa.int32()))], ["id", "y", "x"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("id", F.col("y").cast("int"), "text")
    table = found.mapInArrow(features, "id long, y int, x array<int>").toArrow().sort_by("id")
    y, x = table.column("y").to_numpy(), table.column("x").combine_chunks()
    flat, ends = x.flatten().to_numpy(), np.cumsum(x.value_lengths().to_numpy()) if len(x) else np.empty(0, int)
    xs = [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.001), 0.999)
        return Model(np.zeros(BUCKETS), np.ones(BUCKETS), 0.0, (1.0, float(np.log(share / (1 - share)))))
    kept_out = np.arange(len(y)) % 5 == 4
    if len(set(y[kept_out].tolist())) < 2 or len(set(y[~kept_out].tolist())) < 2:
        kept_out[:] = False
    inside = np.flatnonzero(~kept_out)
    rows_in = [xs[i] for i in inside]
    scale = log_count_ratio(rows_in, y[inside])
    w, b = dual_coordinate_descent(rows_in, y[inside], scale)
    model = Model(w * scale, scale, b, (1.0, 0.0))
    outside = np.flatnonzero(kept_out) if kept_out.any() else inside
    margins = np.array([np.log(p / (1 - p)) for p in (min(max(model.score(xs[i]), 1e-12), 1 - 1e-12) for i in outside)])
    model.curve = calibrate(margins, y[outside])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: list | None = None, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The given columns (all others of docs by default), and under the given names the score and the class."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] if columns is None else columns
    rows = docs.select(*others, F.col(text_col))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = Features(), sent.value
        for batch in batches:
            p = np.array([m.score(of(t.as_py())) for t in batch.column(batch.num_columns - 1)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, score_col, predicted_col])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}`{score_col}` double, `{predicted_col}` int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.where(id_mod(F.col("doc_id"), 3) != 1))
    return score(docs, model, "text", [F.col("doc_id"), (id_mod(F.col("doc_id"), 3) == 1).alias("held_out")])
