"""Nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.store import sized, written

#: Hamming distances of bytes.
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass(frozen=True)
class Codes:
    """Rotations (dims + 1, bits), the centre, the largest norm, and the Hamming radius to search."""

    rotation: np.ndarray
    centre: np.ndarray
    norm: float
    radius: int = 0

    def of(self, x: np.ndarray, *, query: bool = False) -> np.ndarray:
        """Codes (rows x bytes). Rows gain the coordinate that makes all norms equal, so that the inner product
        with a query, whose extra coordinate is 0, orders them as the angle does."""
        norm2 = (x * x).sum(axis=1)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - norm2, 0.0))
        y = np.column_stack([x, extra])
        size = np.sqrt((y * y).sum(axis=1, keepdims=True))
        return np.packbits((y / np.maximum(size, 1e-300) - (0 if query else 1) * self.centre) @ self.rotation >= 0, axis=1)


def learn(x: np.ndarray, norm: float, *, bits: int = 256, rounds: int = 10, seed: int = 4) -> Codes:
    """Iterative quantisation: rotations are turned so that the signs of the rotated rows are near the rows; as many
    rotations, each from another start, as ``bits`` needs."""
    plain = Codes(np.zeros((x.shape[1] + 1, 0)), np.zeros(x.shape[1] + 1), norm)
    y = np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(axis=1), 0.0))]) / max(norm, 1e-300)
    rng, parts, d = np.random.default_rng(seed), [], y.shape[1]
    while sum(p.shape[1] for p in parts) < bits:
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        parts.append(r)
    return Codes(np.hstack(parts)[:, :bits], plain.centre, norm)


class MultiIndex:
    """One index for each byte of the codes: rows sorted by the byte, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.m = codes, codes.shape[1]
        self.long = codes.view(np.uint64)
        self.value = [np.ascontiguousarray(codes[:, j]) for j in range(self.m)]
        self.order = [np.argsort(v, kind="stable").astype(np.int32) for v in self.value]
        self.at = [np.searchsorted(v[o], np.arange(257)) for v, o in zip(self.value, self.order, strict=True)]

    def within(self, code: np.ndarray, radius: int, *, few: int = 16, most: float = 0.4) -> np.ndarray:
        """Every row within ``radius``. Pigeonhole: with radius = m * r + a, such a row has distance <= r in one of
        the first a + 1 parts, or <= r - 1 in one of the others; only those buckets are probed, then whole codes compared.
        Of a part with more than ``few`` near buckets, rows are asked for their bucket; when more than ``most`` of all rows have
        been met, the rest are compared as well, which is cheaper than finding out which of them to leave out."""
        r, a = divmod(radius, self.m)
        seen = np.zeros(len(self.codes), dtype=bool)
        rows = None
        for j in range(self.m):
            near = _NEAR[code[j]] <= (r if j <= a else r - 1)
            hit = np.flatnonzero(near)
            if len(hit) <= few:
                at, order = self.at[j], self.order[j]
                for v in hit.tolist():
                    seen[order[at[v] : at[v + 1]]] = True
            else:
                seen |= near[self.value[j]]
                if np.count_nonzero(seen) > most * len(seen):
                    rows = slice(None)
                    break
        if rows is None:
            rows = np.flatnonzero(seen)
        far = np.bitwise_count(self.long[rows] ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)
        good = np.flatnonzero(far <= radius)
        return good if isinstance(rows, slice) else rows[good]


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows have equal products wherever they stand."""
    return np.multiply(x, q).sum(axis=1)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(score) > 4 * k:
        cut = -np.partition(-score, k - 1)[k - 1]
        keep = np.flatnonzero(score >= cut)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dims)


def usable(vectors: DataFrame) -> tuple[DataFrame, int, float, int]:
    """Rows that take part, as (vec_id, v): arrays of the commonest length without null, NaN or infinite components
    and not all zero. Also their length, largest norm and number."""
    v = F.col("embedding").cast("array<double>")
    # a CASE: rows that fail an early test never reach the later ones
    good = F.when(v.isNull() | (F.size(v) < 1), False).when(F.exists(v, lambda x: x.isNull()), False).otherwise(F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(good)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))
    best = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    if not best:
        return rows, 0, 0.0, 0
    return rows.where(F.size("v") == best[0]["d"]), best[0]["d"], best[0]["norm"], best[0]["n"]


def _best(parts: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def calibrate(rows: DataFrame, codes: Codes, dims: int, n: int, k: int, *, queries: int, recall: float) -> Codes:
    """The radius within which the codes of a sample's true neighbours lie: the ``recall`` quantile of the Hamming distances from
    ``queries`` sampled rows to their k nearest, found by brute force over all rows."""
    unit = F.pmod(F.xxhash64(F.lit(77), "vec_id", "v"), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(unit < queries / max(n, 1)).select("vec_id", "v").toArrow()
    q_ids, q = got.column(0).to_pylist(), _matrix(got.column(1), dims) if len(got) else np.zeros((0, dims))
    q_codes = codes.of(q, query=True)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = np.array([-1 if i is None else i for i in batch.column(0).to_pylist()], dtype=np.int64), _matrix(batch.column(1), dims)
            c = codes.of(x)
            for i, (qid, v) in enumerate(zip(q_ids, q, strict=True)):
                s = _products(x, v)
                if qid is not None:
                    s[ids == qid] = -np.inf
                top = _top(s, ids, k)
                top = top[np.isfinite(s[top])]
                far = np.bitwise_count(c[top].view(np.uint64) ^ q_codes[i].view(np.uint64)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i)), pa.array(s[top]), pa.array(ids[top]), pa.array(far.astype(np.int64))], ["query_no", "score", "vec_id", "far"])

    near = rows.mapInArrow(exact, "query_no long, score double, vec_id long, far long").withColumn("query_id", F.lit(0))
    radius = _best(near, k).agg(F.expr(f"percentile_approx(far, {recall}, 10000)")).first()[0]
    return Codes(codes.rotation, codes.centre, codes.norm, int(radius if radius is not None else codes.rotation.shape[1]))


def search(
    vectors: DataFrame,
    *,
    k: int = 20,
    every: int = 20,
    bits: int = 256,
    fit_rows: int = 4096,
    fit_queries: int = 96,
    recall: float = 0.985,
    block_rows: int = 8192,
    block_queries: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each row whose id is divisible by ``every``.

    Codes and radius are fitted on bounded samples (``fit_rows`` rows, ``fit_queries`` queries against all rows); every row
    is indexed. Rows are dealt into blocks by a hash, each with its own indexes, and every block answers every block
    of queries, which is what the query set asks for; blocks return their k best, which are merged by query. All
    codes within the radius are ranked by the original vectors: no bucket is cut. A query that finds fewer than k
    within the radius in a block takes the whole block.

    Rows that are null, zero or not finite take no part; nor do arrays of another length than the commonest. A query's own row
    is no candidate; another row of its id is one, a repeated row too. Ties go to the smaller id; rows with one id are queries each, and equal ones
    have equal answers. A null id is a candidate only. Empty tables give empty results.
    """
    spark = vectors.sparkSession
    rows, dims, norm, n = usable(vectors)
    out = "query_id long, query_no long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    unit = F.pmod(F.xxhash64(F.lit(78), "vec_id", "v"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(unit < fit_rows / n).select("v").toArrow()
    x = _matrix(sample.column(0), dims) if len(sample) else np.ones((1, dims))
    x = x[np.lexsort(x.T[::-1])]
    codes = calibrate(rows, learn(x, norm, bits=bits), dims, n, k, queries=fit_queries, recall=recall)

    blocks = max(1, -(-n // block_rows))
    asked = F.col("vec_id") % every == 0
    # equal rows are one query, whose answer each copy has in the end
    queries = rows.where(asked).withColumn("query_no", F.xxhash64("vec_id", "v")).groupBy("vec_id", "query_no", "v").agg(F.count("*").alias("copies"))
    queries = written(queries, "ann-queries")
    n_queries = queries.count()
    q_blocks = max(1, -(-n_queries // block_queries))
    base = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(blocks)).cast("int"))
    base = base.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    ask = queries.select("vec_id", "v", "query_no").withColumn("q", F.pmod(F.xxhash64(F.lit(2), "vec_id", "v"), F.lit(q_blocks)).cast("int"))
    ask = ask.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shared = spark.sparkContext.broadcast(codes)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        got: list[list[np.ndarray]] = [[], [], [], []]
        if len(left) and len(right):
            ids = np.array([-1 if i is None else i for i in left.column("vec_id").to_pylist()], dtype=np.int64)
            x, q = _matrix(left.column("v"), dims), _matrix(right.column("v"), dims)
            index, wanted = MultiIndex(m.of(x)), m.of(q, query=True)
            for i, (qid, no) in enumerate(zip(right.column("vec_id").to_pylist(), right.column("query_no").to_pylist(), strict=True)):
                near = index.within(wanted[i], m.radius)
                own = np.flatnonzero((ids == qid) & (x == q[i]).all(axis=1)) if (ids == qid).any() else ids[:0]
                if len(near) - np.isin(own[:1], near).sum() < k:
                    near = np.arange(len(ids))
                near = np.setdiff1d(near, own[:1], assume_unique=True)
                s = _products(x[near], q[i])
                top = _top(s, ids[near], k)
                for g, v in zip(got, (np.full(len(top), qid), np.full(len(top), no), ids[near][top], s[top]), strict=True):
                    g.append(v)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(g) if g else np.zeros(0), type=pa.from_numpy_dtype(t)) for g, t in zip(got, kinds, strict=True)], names=["query_id", "query_no", "vec_id", "score"])

    found = base.groupBy("b", "q").cogroup(ask.groupBy("b", "q")).applyInArrow(answer, out)
    best = _best(found, k)
    more = sized(queries.where("copies > 1").select(F.col("vec_id").alias("again_id"), F.col("query_no").alias("again_no"), "copies"), 500_000)
    best = best.join(more, (F.col("query_id") == F.col("again_id")) & (F.col("query_no") == F.col("again_no")), "left")
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
