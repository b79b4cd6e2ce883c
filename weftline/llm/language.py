"""Language identification by nearest centroid of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.features import bounded_sample, byte_grams, fold_of
from weftline.llm.store import bounded_batches
from weftline.llm.words import chunks

DIMS = 4096
ROWS = 256


@dataclass(frozen=True)
class LanguageModel:
    """Unit centroids (rows) with their language and the least cosine each accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    least: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(n, 1e-12)


def _tf(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts.astype(np.float32))


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """Unit centroids of unit rows; far rows seed them, empty clusters are left out."""
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[[int((x @ c.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        new = _unit(np.vstack([x[near == j].sum(axis=0) for j in range(len(c)) if (near == j).any()]))
        if new.shape == c.shape and np.abs(new - c).max() < 1e-6:
            break
        c = new
    return c


def fit(docs: DataFrame, *, folds: int = 3, held_fold: int = 1, most_rows: int = 2400, per_language: int = 4, reject: float = 0.002, seed: int = 9) -> LanguageModel:
    """Document frequencies come from all rows whose fold is not ``held_fold`` and whose lang is known; centroids
    (``per_language`` clusters each) from a bounded sample of about ``most_rows`` of them. A centroid's least cosine
    is the ``reject`` quantile over its cluster."""
    known = bounded_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_fold))

    def df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(DIMS, dtype=np.int64)
        for batch in batches:
            for c in chunks(batch.column(0), most_rows=ROWS):
                seen += (byte_grams(c, DIMS) > 0).sum(axis=0)
                n += c.hi - c.lo
        got = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(got, -1)), pa.array(np.append(seen[got], n))], ["f", "n"])

    rows = known.select("text").mapInArrow(df, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    freq = {r["f"]: r["n"] for r in rows}
    n = freq.pop(-1, 0)
    idf = np.ones(DIMS, dtype=np.float32)
    for f, k in freq.items():
        idf[f] = np.log((1 + n) / (1 + k)) + 0.05

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), most_rows=ROWS):
                v = _unit(_tf(byte_grams(c, DIMS)) * idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo), pa.array([r.tobytes() for r in v], pa.binary())], ["lang", "v"])

    got = bounded_sample(known, "doc_id", most_rows, by="lang").select("lang", "text").mapInArrow(vectors, "lang string, v binary").toArrow().sort_by([("lang", "ascending"), ("v", "ascending")]) if n else None
    langs, cents, least = [], [], []
    if got is not None and len(got):
        lang = np.array(got.column("lang").to_pylist())
        x = np.vstack([np.frombuffer(b, dtype=np.float16).astype(np.float32) for b in got.column("v").to_pylist()])
        for name in sorted(set(lang.tolist())):
            mine = x[lang == name]
            mine = mine[(mine != 0).any(axis=1)]
            if not len(mine):
                continue
            c = spherical_kmeans(mine, per_language, seed)
            cos = mine @ c.T
            near = cos.argmax(axis=1)
            for j in range(len(c)):
                own = cos[near == j, j]
                langs.append(name)
                cents.append(c[j])
                least.append(float(np.quantile(own, reject)) if len(own) else 0.0)
    return LanguageModel(idf, np.vstack(cents).astype(np.float32) if cents else np.zeros((0, DIMS), dtype=np.float32), tuple(langs), np.array(least))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid, 0 to 1), rejected (nearer to none than its cluster's
    rows are; the nearest language is still named). Texts that are null or without a letter are ``und`` with score 0
    and rejected, as all texts are if nothing could be learned. Repeated rows agree; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for c in chunks(batch.column(2), most_rows=ROWS):
                ok = letters[c.lo : c.hi]
                if len(m.langs):
                    cos = _unit(_tf(byte_grams(c, DIMS)) * m.idf) @ m.centroids.T
                    best = cos.argmax(axis=1)
                    top = np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1)
                    far = top < m.least[best]
                    name = [m.langs[j] if k else "und" for j, k in zip(best.tolist(), ok.tolist(), strict=True)]
                else:
                    top, far, name = np.zeros(len(ok)), np.ones(len(ok), dtype=bool), ["und"] * len(ok)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.hi - c.lo).cast(pa.int64()), pa.array(name), pa.array(np.where(ok, top, 0.0)), pa.array(far | ~ok)], ["doc_id", "lang_pred", "score", "rejected"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), letter.alias("letter"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, lang_pred string, score double, rejected boolean")
