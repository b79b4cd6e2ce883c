"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.features import bounded_sample, fold_of
from weftline.llm.store import bounded_batches
from weftline.llm.words import Chunk, chunks, words

SEGMENTS = "array<struct<start:int,end:int,score:double>>"
_SEG = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


@dataclass(frozen=True)
class ToxicModel:
    """Positive tokens by hash (sorted) with their scores, the drift of all others, and the calibration."""

    tokens: np.ndarray
    scores: np.ndarray
    drift: float
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] = (-4.0, 1.0, 0.5)


def segments(left: list[float], right: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence, in linear time.

    ``left[i]`` and ``right[i]`` are running sums before and after the i-th positive item. Each candidate looks
    for the nearest one to the left with a smaller left sum; if that one's right sum is smaller too, both merge.
    Returns (first item, last item, score), in order."""
    kept: list[list] = []  # first, last, left sum, right sum, link to the nearest with a smaller left sum
    for i, (lo, hi) in enumerate(zip(left, right, strict=True)):
        cur = [i, i, lo, hi, -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= cur[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= cur[3]:
                cur[4] = j
                kept.append(cur)
                break
            cur = [kept[j][0], cur[1], kept[j][2], cur[3], -1]
            del kept[j:]
    return [(a, b, r - lo) for a, b, lo, r, _ in kept]


def passages(model: ToxicModel, c: Chunk) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """For each row its number of words and its maximal segments as (start byte, end byte, score)."""
    w = words(c, signs=True)
    s = np.full(len(w.hash), -model.drift)
    if len(model.tokens) and len(w.hash):
        at = np.searchsorted(model.tokens, w.hash)
        at[at == len(model.tokens)] = 0
        hit = model.tokens[at] == w.hash
        s[hit] = model.scores[at[hit]]
    run = np.concatenate(([0.0], np.cumsum(s)))
    good = np.flatnonzero(s > 0)
    cut = np.searchsorted(good, w.first)
    for i in range(c.hi - c.lo):
        n, mine = int(w.first[i + 1] - w.first[i]), good[cut[i] : cut[i + 1]]
        if not len(mine):
            yield n, []
            continue
        found = segments(run[mine].tolist(), run[mine + 1].tolist())
        yield n, [(int(w.start[mine[a]] - c.at[i]), int(w.end[mine[b]] - c.at[i]), x) for a, b, x in found]


def evidence(model: ToxicModel, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
    """Of the best segment, and of all: how far scores lie above what chance gives a text of n words."""
    if not found:
        return 0.0, 0.0
    chance = model.log_k + np.log(max(n, 1))
    each = [max(0.0, model.lam * x - chance) for _, _, x in found]
    return float(np.log1p(max(each))), float(np.log1p(sum(each)))


def _sigmoid(x: np.ndarray | float):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ b)
        g = x.T @ (y - p) - ridge * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def decay(scores: np.ndarray, share: np.ndarray, drift: float) -> float:
    """lambda of the extreme-value law P(best segment >= x) = 1 - exp(-K n exp(-lambda x)): the positive root of
    E exp(lambda s) = 1 over the words of clean texts, of which positive tokens are ``share`` and the rest cost ``drift``."""
    if not len(scores):
        return 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * scores, 500))).sum() + (1 - share.sum()) * np.exp(-x * drift)) - 1
    lo, hi = 0.0, 1e-3
    while value(hi) < 0 and hi < 64:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return max(hi, 0.05)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    folds: int = 5,
    held_fold: int = 0,
    most_labels: int = 16000,
    prior: float = 0.5,
    drift: float = 1.0,
    caution: float = 1.0,
    least_count: int = 3,
) -> ToxicModel:
    """Learn from labelled rows whose fold is not ``held_fold``, about ``most_labels`` of them at most
    (a bounded sample, so that its ids can be broadcast). The last fold calibrates, the others count tokens.

    A token counts once a text, so that one text's favourite word says little. Its score is the lower end (``caution`` standard errors) of its log-odds between toxic and clean texts under
    a Dirichlet prior, less ``drift``; tokens that aren't positive all cost ``drift``.
    """
    fold = fold_of(F.col("doc_id"), folds)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.col("fold") != held_fold))
    picked = bounded_sample(usable.distinct(), "doc_id", most_labels, by="toxic")
    texts = bounded_batches(docs).select("doc_id", F.lower(F.col("text").cast("string")).alias("text")).join(F.broadcast(picked), "doc_id").select("fold", "toxic", "text")
    last = folds - 1 if held_fold != folds - 1 else folds - 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(2)):
                w = words(c, signs=True)
                order = np.lexsort((w.hash, w.doc))
                h, doc = w.hash[order], w.doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                key, at = np.unique(h[new], return_inverse=True)
                bad = toxic[c.lo : c.hi][doc[new]] == 1
                n1 = np.bincount(at[bad], minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, minlength=len(key)) - n1), pa.array(n1)], ["w", "n0", "n1"])

    counted = texts.where(F.col("fold") != last).mapInArrow(count, "w long, n0 long, n1 long")
    counted = counted.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    t = counted.agg(F.sum("n0"), F.sum("n1"), F.count("*")).first()
    if not t[0] or not t[1]:
        return ToxicModel(np.zeros(0, dtype=np.uint64), np.zeros(0), drift, weights=(-4.0, 0.0, 0.0))
    all0, all1 = t[0] + prior * t[2], t[1] + prior * t[2]
    y0, y1 = F.col("n0") + prior, F.col("n1") + prior
    odds = F.log(y1 / (all1 - y1)) - F.log(y0 / (all0 - y0))
    score = odds - caution * F.sqrt(1 / y0 + 1 / y1) - drift
    rows = counted.where(F.col("n1") >= least_count).select("w", score.alias("s"), (y0 / all0).alias("p")).where("s > 0").toArrow()
    w, s = rows.column("w").to_numpy().view(np.uint64), rows.column("s").to_numpy()
    order = np.argsort(w)
    lam = decay(s, rows.column("p").to_numpy(), drift)
    model = ToxicModel(w[order], s[order], drift, lam)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                got = [(n, [x for _, _, x in found]) for n, found in passages(model, c)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(c.lo, c.hi - c.lo).cast(pa.int32()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["toxic", "n", "s"])

    held = texts.where(F.col("fold") == last).mapInArrow(best, "toxic int, n long, s array<double>").toArrow().to_pylist()
    # K: how often a segment starts in clean texts
    clean = [r for r in held if r["toxic"] != 1]
    log_k = float(np.log((sum(len(r["s"]) for r in clean) + 0.5) / (sum(r["n"] for r in clean) + 1.0)))
    model = ToxicModel(model.tokens, model.scores, drift, lam, log_k)
    x = np.array([evidence(model, r["n"], [(0, 0, v) for v in r["s"]]) for r in held]).reshape(len(held), 2)
    y = np.array([float(r["toxic"] == 1) for r in held])
    if y.min(initial=1) == y.max(initial=0):
        return model
    b = _logistic(x, y)
    return ToxicModel(model.tokens, model.scores, drift, lam, log_k, tuple(float(v) for v in b))


def probabilities(model: ToxicModel, found: list[tuple[int, list[tuple[int, int, float]]]]) -> np.ndarray:
    ev = np.array([evidence(model, n, f) for n, f in found]).reshape(len(found), 2)
    return _sigmoid(model.weights[0] + ev @ np.array(model.weights[1:]))


def toxic_column(spark: SparkSession, model: ToxicModel) -> Callable[[Column], Column]:
    """A function of a text column: whether its score is at least one half. Only texts go to Python, other columns stay where they are."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def toxic(texts: pa.Array) -> pa.Array:
        out = [probabilities(shared.value, list(passages(shared.value, c))) >= 0.5 for c in chunks(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, dtype=bool))

    return lambda text: toxic(F.lower(text.cast("string")))


def score(docs: DataFrame, model: ToxicModel, *, keep: list[Column] | None = None) -> DataFrame:
    """doc_id, score (0 to 1), predicted and segments (byte offsets in the lower-cased text of every maximal passage and its score) of
    every row's whole text; columns in ``keep`` pass through. Null and empty texts have no segment and the least score.
    Repeated rows have equal scores; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = bounded_batches(docs).select(*([F.col("doc_id")] if keep is None else keep), F.lower(F.col("text").cast("string")).alias("lower text"))
    at, passing = len(base.columns) - 1, base.schema.fields[:-1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = [f.name for f in passing] + ["score", "predicted", "segments"]
        for batch in batches:
            for c in chunks(batch.column(at)):
                got = list(passages(m, c))
                p = probabilities(m, got)
                segs = pa.array([[{"start": a, "end": b, "score": x} for a, b, x in f] for _, f in got], _SEG)
                own = [batch.column(i).slice(c.lo, c.hi - c.lo) for i in range(at)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), segs], names)

    schema = T.StructType([*passing, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("segments", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])))])
    return base.mapInArrow(apply, schema)
