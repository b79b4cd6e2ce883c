"""Text quality by ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.features import bounded_sample, byte_grams, fold_of, word_counts
from weftline.llm.store import bounded_batches
from weftline.llm.words import Chunk, chunks

DIMS = 2048
ROWS = 256


@dataclass(frozen=True)
class QualityModel:
    """Shared weights of the hashed text, and ordered thresholds: P(grade <= k) = s(threshold k - w x)."""

    weights: np.ndarray
    thresholds: np.ndarray


def features(c: Chunk) -> np.ndarray:
    """Byte 1- to 3-grams as written and words without case or signs, each hashed, damped and of unit length."""
    out = []
    for counts in (byte_grams(c, DIMS, fold=False), word_counts(c, DIMS)):
        x = np.sqrt(counts.astype(np.float32))
        out.append(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-6))
    return np.hstack(out)


def _s(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, *, rounds: int = 200, rate: float = 0.1, ridge: float = 2e-5) -> QualityModel:
    """Maximum likelihood of the proportional-odds model, by Adam over all rows; thresholds keep their order as
    they are a first one and exponentials of gaps."""
    y = y.astype(int)
    n, d = x.shape
    share = np.clip(np.array([(y <= k).mean() for k in range(grades - 1)]), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(d), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, gaps = p[:d], np.exp(p[d + 1 :])
        th = p[d] + np.concatenate(([0.0], np.cumsum(gaps)))
        z = x @ w.astype(np.float32)
        up = np.where(y < grades - 1, _s(th[np.minimum(y, grades - 2)] - z), 1.0)
        lo = np.where(y > 0, _s(th[np.maximum(y - 1, 0)] - z), 0.0)
        q = np.maximum(up - lo, 1e-9)
        du, dl = up * (1 - up), lo * (1 - lo)
        g = np.zeros_like(p)
        g[:d] = x.T @ ((du - dl) / q / n).astype(np.float32) + 2 * ridge * w
        dth = np.array([-(du / q)[y == k].sum() + (dl / q)[y == k + 1].sum() for k in range(grades - 1)]) / n
        g[d] = dth.sum()
        for j in range(len(gaps)):
            g[d + 1 + j] = dth[j + 1 :].sum() * gaps[j]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    th = p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))
    return QualityModel(p[:d].astype(np.float32), th)


def grade_column():
    """Graded rating of a label: 0 low quality, 1 good but toxic, 2 good and not toxic; null where what decides is null."""
    return F.when(F.col("quality") != 1, 0).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), F.when(F.col("toxic") == 1, 1).otherwise(2))


def fit(docs: DataFrame, ratings: DataFrame, *, grades: int = 3, folds: int = 5, held_fold: int = 0, most_rows: int = 6000) -> QualityModel:
    """``ratings``: (doc_id, grade). Learns from rows whose fold isn't ``held_fold``, about ``most_rows`` of them at most,
    the same share of each grade; null ids and grades are left out; thresholds are then moved back to the grades' shares of all ratings."""
    known = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_fold)).distinct()
    shares = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    picked = bounded_sample(known, "doc_id", most_rows, by="grade")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), most_rows=ROWS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo).cast(pa.int32()), pa.array([r.tobytes() for r in features(c).astype(np.float16)], pa.binary())], ["grade", "v"])

    got = bounded_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("grade", "text").mapInArrow(vectors, "grade int, v binary").toArrow().sort_by([("grade", "ascending"), ("v", "ascending")])
    if len(got) < 2 or len(shares) < 2:
        return QualityModel(np.zeros(2 * DIMS, dtype=np.float32), np.linspace(-1, 1, grades - 1))
    x = np.empty((len(got), 2 * DIMS), dtype=np.float32)
    for i, v in enumerate(got.column("v")):
        x[i] = np.frombuffer(v.as_py(), dtype=np.float16)
    y = got.column("grade").to_numpy()
    model = fit_ordinal(x, y, grades)
    all_, mine = sum(shares.values()), np.bincount(y, minlength=grades) / len(y)
    logit = lambda p: np.log(p / (1 - p))
    move = [logit(np.clip(sum(shares.get(j, 0) for j in range(k + 1)) / all_, 1e-3, 1 - 1e-3)) - logit(np.clip(mine[: k + 1].sum(), 1e-3, 1 - 1e-3)) for k in range(grades - 1)]
    return QualityModel(model.weights, np.sort(model.thresholds + np.array(move)))


def score(docs: DataFrame, model: QualityModel, *, keep_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail (P of each grade or more, from grade 1), tail_prob (P(grade >= 1)) and selected
    (tail_prob >= ``keep_tail``) for every row's whole text. Null and empty texts have no features, so the thresholds alone
    decide, and are never selected. Repeated rows agree; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for c in chunks(batch.column(1), most_rows=ROWS):
                z = (features(c) @ m.weights).astype(np.float64)
                tail = _s(z[:, None] - m.thresholds[None, :])
                some = np.diff(c.at) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.hi - c.lo).cast(pa.int64()), pa.array(tail.sum(axis=1)), pa.array(list(tail), pa.list_(pa.float64())), pa.array(tail[:, 0]), pa.array((tail[:, 0] >= keep_tail) & some)],
                    ["doc_id", "expected_grade", "tail", "tail_prob", "selected"],
                )

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, expected_grade double, tail array<double>, tail_prob double, selected boolean")
