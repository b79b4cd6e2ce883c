"""Benchmark decontamination by latent semantic retrieval and longest common subsequences."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.store import bounded_batches, written
from weftline.llm.words import Chunk, Words, chunks, words

#: Words of a passage, and how far apart passages begin.
SPAN, STEP = 24, 8
_U = np.uint64


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages of each row as (first word, end word): every STEP words, the last one ending with the row."""
    lo, hi = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b > a:
            s = np.arange(a, max(a + 1, b - SPAN + STEP), STEP)
            lo.append(s)
            hi.append(np.minimum(s + SPAN, b))
    if not lo:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(lo), np.concatenate(hi)


@dataclass(frozen=True)
class Latent:
    """Items as word hashes, their vocabulary with idf and (weighted) latent vectors, and the latent vectors of their passages."""

    items: tuple[np.ndarray, ...]
    item_ids: tuple[int, ...]
    vocab: np.ndarray
    idf: np.ndarray
    idf_else: float
    rows: np.ndarray
    passages: np.ndarray
    passage_item: np.ndarray


def document_frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[int, np.ndarray]:
    """Over all documents: their number, and how many hold each word of ``vocab``. Only those counts are gathered,
    as many as the benchmark has words; each batch is combined before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        n, seen = 0, np.zeros(len(v) + 1, dtype=np.int64)
        for batch in batches:
            for c in chunks(batch.column(0)):
                w = words(c, signs=True)
                n += c.hi - c.lo
                at = _find(v, w.hash)
                hit = np.flatnonzero(at < len(v))
                pair = np.unique(w.doc[hit] * np.int64(len(v) + 1) + at[hit])
                seen += np.bincount(pair % (len(v) + 1), minlength=len(v) + 1)
        got = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(got, -1)), pa.array(np.append(seen[got], n))], ["w", "n"])

    rows = bounded_batches(docs).select(F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(len(vocab)), 0
    for r in rows:
        if r["w"] < 0:
            n = r["n"]
        else:
            df[r["w"]] = r["n"]
    return n, df


def _find(vocab: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary; its length for other words."""
    if not len(vocab) or not len(h):
        return np.full(len(h), len(vocab), dtype=np.int64)
    at = np.searchsorted(vocab, h)
    at[at == len(vocab)] = 0
    return np.where(vocab[at] == h, at, len(vocab))


def randomised_svd(items: DataFrame, vocab: np.ndarray, idf: np.ndarray, rank: int, *, over: int = 16, power: int = 2, seed: int = 6) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the passages' TF-IDF rows. Rows stay on the executors: each pass sums A'(A Q) over
    them, and only a sketch of (vocabulary x rank + over) comes back, to be made orthonormal."""
    d = len(vocab)
    k = min(rank + over, d)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, k)))
    spark = items.sparkSession
    for _ in range(power + 1):
        shared = spark.sparkContext.broadcast((vocab, idf, q))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, f, y = shared.value
            out, some = np.zeros((len(v), y.shape[1])), False
            for batch in batches:
                for c in chunks(batch.column(0), 1 << 18):
                    w = words(c, signs=True)
                    at = _find(v, w.hash)
                    lo, hi = _blocks(w.first)
                    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                        t = at[a:b]
                        t = t[t < len(v)]
                        norm = np.sqrt((f[t] ** 2).sum())
                        if norm > 0:
                            x = f[t] / norm
                            np.add.at(out, t, np.outer(x, x @ y[t]))
                            some = True
            if some:
                at = np.flatnonzero(np.abs(out).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(out[at]), pa.list_(pa.float64()))], ["w", "y"])

        sums = [F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(k)]
        got = items.select(F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(product, "w long, y array<double>").groupBy("w").agg(*sums).toArrow()
        z = np.zeros((d, k))
        if len(got):
            z[got.column("w").to_numpy()] = np.column_stack([got.column(f"y{j}").to_numpy() for j in range(k)])
        q, r = np.linalg.qr(z)
    u, s, _ = np.linalg.svd(r)
    return (q @ u)[:, :rank]


def _weighted(idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What each word adds to a passage's latent vector; the last row is that of all other words."""
    return np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)


def _latent(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, idf: np.ndarray, rows: np.ndarray, idf_else: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit latent vectors of passages, and the share of their TF-IDF norm that the vocabulary has."""
    w = np.append(idf, 0.0)[at]
    sq = np.concatenate(([0.0], np.cumsum(w * w)))
    other = np.concatenate(([0.0], np.cumsum(np.where(at == len(idf), idf_else**2, 0.0))))
    own, rest = sq[hi] - sq[lo], other[hi] - other[lo]
    share = np.sqrt(own / np.maximum(own + rest, 1e-12))
    y = np.zeros((len(lo), rows.shape[1]), dtype=np.float32)
    for k in range(0, len(lo), 512):
        a, b = lo[k : k + 512, None], hi[k : k + 512, None]
        i = a + np.arange(SPAN)
        y[k : k + 512] = rows[np.where(i < b, at[np.minimum(i, len(at) - 1)], len(idf))].sum(axis=1)
    n = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return y / np.maximum(n, 1e-12), share


def fit(docs: DataFrame, benchmark: DataFrame, *, rank: int = 96, most_items: int = 100_000) -> Latent:
    """The latent space of the benchmark's passages, with word weights from all documents. The benchmark goes to every
    executor, so it has to have at most ``most_items`` items (else an error says so; ``in_parts`` makes parts of a larger one); the corpus may
    have any size. Null and empty items are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where(F.col("text").isNotNull())
    table = rows.limit(most_items + 1).toArrow()
    if len(table) > most_items:
        raise ValueError(f"the benchmark has more than {most_items} items; fit it in_parts")
    items, ids = [], []
    for c in chunks(table.column("text").combine_chunks()) if len(table) else ():
        w = words(c, signs=True)
        for i, item in enumerate(table.column("item_id").to_pylist()[c.lo : c.hi]):
            h = w.hash[w.first[i] : w.first[i + 1]]
            if len(h) and item is not None:
                items.append(h)
                ids.append(item)
    vocab = np.unique(np.concatenate(items)) if items else np.zeros(0, dtype=np.uint64)
    n, df = document_frequencies(docs, vocab) if items else (0, np.zeros(0))
    idf = np.log((n + 1) / (df + 1)) + 0.1
    idf_else = float(np.log(n + 1) * 0.75 + 0.1)
    if not items:
        return Latent((), (), vocab, idf, idf_else, np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, dtype=np.int64))
    each = _weighted(idf, randomised_svd(rows, vocab, idf, min(rank, len(vocab))))
    first = np.concatenate(([0], np.cumsum([len(h) for h in items])))
    at = _find(vocab, np.concatenate(items))
    lo, hi = _blocks(first)
    vec, _ = _latent(at, lo, hi, idf, each, idf_else)
    return Latent(tuple(items), tuple(ids), vocab, idf, idf_else, each, vec, np.searchsorted(first, lo, side="right") - 1)


def in_parts(benchmark: DataFrame, most_items: int = 100_000) -> list[DataFrame]:
    """A benchmark of any size in parts that ``fit`` takes, by a hash of the item's id and text."""
    n = benchmark.count()
    ways = 1 if n <= most_items else -(-2 * n // most_items)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(ways))
    return [benchmark] if ways == 1 else [benchmark.where(part == k) for k in range(ways)]


def all_matches(docs: DataFrame, benchmark: DataFrame, *, most_items: int = 100_000, **options) -> DataFrame:
    """``matches`` against a benchmark of any size: a pass for each part of it, one part's model on the executors at a time, between passes a
    written table. doc_id and hits, the best first."""
    parts = in_parts(benchmark, most_items)
    if len(parts) == 1:
        return matches(docs, fit(docs, benchmark, most_items=most_items), **options)
    out = docs.select("doc_id", "text", F.array().cast(_HIT).alias("hits so far"))
    for part in parts:
        found = matches(out, fit(docs, part, most_items=most_items), keep=[F.col("doc_id"), F.col("text"), F.col("`hits so far`")], **options)
        out = written(found.select("doc_id", "text", F.concat("hits so far", "hits").alias("hits so far")), "hits")
    best = lambda x, y: F.when(x["lcs"] != y["lcs"], F.when(x["lcs"] > y["lcs"], -1).otherwise(1)).when(x["item_id"] < y["item_id"], -1).when(x["item_id"] > y["item_id"], 1).otherwise(0)
    return out.select("doc_id", F.array_sort("hits so far", best).alias("hits"))


def _steps(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence of two word lists, and how much of ``b`` it needs, in words of bits."""
    place: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, seen, last = full, 0, 0
    for j, x in enumerate(b.tolist()):
        u = v & place.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
            now = len(a) - v.bit_count()
            if now > seen:
                seen, last = now, j + 1
    return seen, last


def lcs(a: np.ndarray, b: np.ndarray, least: int = 0) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and where in ``b`` it begins and ends: the earliest end, and the latest
    begin for it. Below ``least`` the places aren't sought."""
    n, end = _steps(a, b)
    if n < max(1, least):
        return n, 0, 0
    return n, end - _steps(a[::-1], b[:end][::-1])[1], end


def _reach(size: int) -> int:
    """How far a copy or paraphrase of ``size`` words may stretch: it keeps close together, scattered common words don't."""
    return int(1.6 * size + 4)


def closest(item: np.ndarray, b: np.ndarray, starts: list[int], *, ratio: float, answer_ratio: float, answer_words: int) -> tuple[int, bool, int, int] | None:
    """The longest common subsequence within ``_reach`` words of ``b`` that makes a hit: its length, whether the answer is
    there, begin and end. Every start in ``starts`` is looked at, but for those that the item's words gained since the last
    one can't bring up to what is sought."""
    size, tail, most = len(item), item[-min(answer_words, len(item)) :], _reach(len(item))
    place: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        place[x] = place.get(x, 0) | (1 << i)
    spots = [(j, place[x]) for j, x in enumerate(b.tolist()) if x in place]
    bits, where = [x for _, x in spots], [j for j, _ in spots]
    full, sought, best = (1 << size) - 1, _least(size, ratio, answer_ratio), None
    last, had = 0, None
    for s in starts:
        i, e = bisect_left(where, s), bisect_left(where, s + most)
        if e - i < sought or (had is not None and had + e - last < sought):
            continue
        v = full
        for x in bits[i:e]:
            u = v & x
            if u:
                v = ((v + u) | (v - u)) & full
        had, last = size - v.bit_count(), e
        if had < sought:
            continue
        n, f, end = lcs(item, b[s : s + most])
        answer = n >= answer_ratio * size and _steps(tail, b[s + f : s + end])[0] >= 0.8 * len(tail)
        if n >= ratio * size or answer:
            best, sought = (n, bool(answer), s + f, s + end), n + 1
    return best


def _least(size: int, ratio: float, answer_ratio: float) -> int:
    return max(1, int(np.ceil(min(ratio, answer_ratio) * size - 1e-9)))


def tested(m: Latent, c: Chunk, w: Words, *, cosine: float, ratio: float, answer_ratio: float, answer_words: int) -> list[tuple[int, int, float, float, bool, int, int]]:
    """Found passages of a chunk: (row, item place, cosine, LCS ratio, whether the answer is there, first byte, end byte)."""
    at = _find(m.vocab, w.hash)
    lo, hi = _blocks(w.first)
    if not len(lo) or not len(m.items):
        return []
    # a cosine is at most the share of the passage's norm that lies in the vocabulary: no passage below it can pass
    sq = np.append(m.idf, 0.0)[at] ** 2
    run, rest = np.concatenate(([0.0], np.cumsum(sq))), np.concatenate(([0.0], np.cumsum(np.where(at == len(m.idf), m.idf_else**2, 0.0))))
    own, out = run[hi] - run[lo], rest[hi] - rest[lo]
    some = np.flatnonzero(own >= cosine**2 * np.maximum(own + out, 1e-12) * (1 - 1e-6))
    if not len(some):
        return []
    vec, part = _latent(at, lo[some], hi[some], m.idf, m.rows, m.idf_else)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(0, len(some), 2048):
        cos = ((vec[k : k + 2048] * part[k : k + 2048, None].astype(np.float32)) @ m.passages.T).ravel()
        hit = np.flatnonzero(cos >= cosine)
        i, j = np.divmod(hit, len(m.passages))
        pairs.append((some[k + i], m.passage_item[j], cos[hit]))
    near, item_of, cosines = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if not len(near):
        return []
    # every candidate counts: those of a row and an item whose surroundings meet are one region
    row_of = w.doc[lo[near]]
    order = np.lexsort((near, row_of, item_of))
    near, item_of, cosines, row_of = near[order], item_of[order], cosines[order], row_of[order]
    most = np.array([_reach(len(x)) for x in m.items])[item_of]
    a, b = np.maximum(w.first[row_of], lo[near] - most), np.minimum(w.first[row_of + 1], hi[near] + most)
    begin = np.flatnonzero(np.concatenate(([True], (item_of[1:] != item_of[:-1]) | (row_of[1:] != row_of[:-1]) | (a[1:] > b[:-1]))))
    a, b, item_of, row_of, cosines = a[begin], np.maximum.reduceat(b, begin), item_of[begin], row_of[begin], np.maximum.reduceat(cosines, begin)
    got: dict[tuple[int, int], tuple] = {}
    mine = np.zeros(len(m.vocab) + 1, dtype=np.int64)
    edges = np.flatnonzero(np.concatenate(([True], item_of[1:] != item_of[:-1], [True])))
    for g, h in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        item = int(item_of[g])
        words_of, times = np.unique(np.searchsorted(m.vocab, m.items[item]), return_counts=True)
        sizes = b[g:h] - a[g:h]
        ends = np.cumsum(sizes)
        flat = at[np.arange(ends[-1]) + np.repeat(a[g:h] - (ends - sizes), sizes)]
        mine[words_of] = times
        s = np.flatnonzero(mine[flat])
        region = np.searchsorted(ends, s, side="right")
        # no start is a hit's unless its reach has as many of the item's words, each as often as the item at most
        word = flat[s]
        by = np.argsort(word, kind="stable")
        back = np.arange(len(s)) - mine[word[by]]
        mine[words_of] = 0
        before = np.full(len(s), -1, dtype=np.int64)
        before[by] = np.where((back >= 0) & (word[by[np.maximum(back, 0)]] == word[by]), s[by[np.maximum(back, 0)]], -1)
        low = np.maximum(np.maximum(before, s - _reach(len(m.items[item]))), (ends - sizes)[region] - 1) + 1
        held = np.cumsum(np.bincount(low, minlength=len(flat) + 1) - np.bincount(s + 1, minlength=len(flat) + 1))
        size = len(m.items[item])
        good = held[s] >= _least(size, ratio, answer_ratio)
        s, region = s[good], region[good]
        cuts = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True]))) if len(s) else ()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            r = int(region[x])
            first, end, row = int(a[g + r]), int(b[g + r]), int(row_of[g + r])
            old = got.get((row, item))
            if old is not None and old[3] >= 0.999:
                continue
            found = closest(m.items[item], w.hash[first:end], (s[x:y] - int(ends[r] - sizes[r])).tolist(), ratio=ratio, answer_ratio=answer_ratio, answer_words=answer_words)
            if found is not None and (old is None or found[0] / size > old[3]):
                n, answer, f, e = found
                got[row, item] = (row, item, float(cosines[g + r]), n / size, answer, int(w.start[first + f] - c.at[row]), int(w.end[first + e - 1] - c.at[row]))
    return list(got.values())


_HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.DoubleType()), T.StructField("answer", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_HIT_PA = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))


def matches(
    docs: DataFrame,
    model: Latent,
    *,
    keep: list[Column] | None = None,
    cosine: float = 0.2,
    ratio: float = 0.6,
    answer_ratio: float = 0.5,
    answer_words: int = 5,
) -> DataFrame:
    """doc_id and hits of every row: benchmark items of which its whole text holds a copy or a paraphrase.

    Passages of all documents whose cosine to an item's passage is at least ``cosine`` are candidates. Around every one, the
    longest common subsequence with the item within 1.6 times its words (and four) is measured; the document is contaminated if it covers ``ratio`` of the
    item's words, or ``answer_ratio`` with most of the item's last ``answer_words`` (the answer) in place. A hit names item, cosine,
    LCS ratio, answer and the bytes (of the lower-cased text) from the first to the last common word. Rows without hits, null and empty texts have
    an empty array; repeated rows agree; empty tables give empty results or no hits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = bounded_batches(docs).select(*([F.col("doc_id")] if keep is None else keep), F.lower(F.col("text").cast("string")).alias("lower text"))
    at, passing = len(base.columns) - 1, base.schema.fields[:-1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for c in chunks(batch.column(at)):
                hits: list[list[dict]] = [[] for _ in range(c.hi - c.lo)]
                for row, item, cos, r, answer, a, b in tested(m, c, words(c, signs=True), cosine=cosine, ratio=ratio, answer_ratio=answer_ratio, answer_words=answer_words):
                    hits[row].append({"item_id": m.item_ids[item], "cosine": cos, "lcs": r, "answer": answer, "start": a, "end": b})
                for h in hits:
                    h.sort(key=lambda x: (-x["lcs"], x["item_id"]))
                own = [batch.column(i).slice(c.lo, c.hi - c.lo) for i in range(at)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(hits, _HIT_PA)], [f.name for f in passing] + ["hits"])

    return base.mapInArrow(apply, T.StructType([*passing, T.StructField("hits", _HIT)]))


def contaminated_column(spark: SparkSession, model: Latent, *, cosine: float = 0.2, ratio: float = 0.6, answer_ratio: float = 0.5, answer_words: int = 5) -> Callable[[Column], Column]:
    """A function of a text column: whether ``matches`` finds a hit in it. Only texts go to Python, other columns stay where they are."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        out = []
        for c in chunks(texts):
            some = np.zeros(c.hi - c.lo, dtype=bool)
            for row, *_ in tested(shared.value, c, words(c, signs=True), cosine=cosine, ratio=ratio, answer_ratio=answer_ratio, answer_words=answer_words):
                some[row] = True
            out.append(some)
        return pa.array(np.concatenate(out) if out else np.zeros(0, dtype=bool))

    return lambda text: hit(F.lower(text.cast("string")))
