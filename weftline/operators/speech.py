"""Relational operators over speech records. Times are integer milliseconds until the last projection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import scalars as S

# fixed values: quality gate (ms, ms, confidence), gaps at which turns merge (ms)
LEAST_MS, MOST_MS, LEAST_CONFIDENCE = 1000, 30000, 0.3
TURN_GAP_MS, WINDOW_GAP_MS = 100, 500
# fixed values: reference clips (ms, ms, guard ms; weights of duration, place, text, loudness)
CLIP_LEAST, CLIP_MOST, CLIP_GUARD = 12000, 18000, 5000
W_DURATION, W_PLACE, W_TEXT, W_RMS = 1.0, 0.5, 3.0, 2.0


def assign_speakers(segments: DataFrame, turns: DataFrame, *, bucket_ms: int = 10000) -> DataFrame:
    """Each segment with the turn that it overlaps most; ties go to the earlier start, then to the earlier turn.

    Segments and turns are dealt into time buckets that they touch and joined on (source, bucket), so the join is
    an equi-join that spreads one long source over many tasks. A pair is taken in the one bucket where the later of both
    begins, so no pair counts twice; the best turn is a struct maximum, combined before the shuffle.
    """
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bucket_ms), F.floor((hi - 1) / bucket_ms)))
    s = segments.where("e_ms > s_ms").withColumn("bucket", spread(F.col("s_ms"), F.col("e_ms")))
    t = turns.where("te_ms > ts_ms").withColumn("bucket", spread(F.col("ts_ms"), F.col("te_ms")))
    pair = s.join(t, ["source_id", "bucket"]).where((F.col("s_ms") < F.col("te_ms")) & (F.col("ts_ms") < F.col("e_ms")))
    pair = pair.where(F.floor(F.greatest("s_ms", "ts_ms") / bucket_ms) == F.col("bucket"))
    overlap = F.least("e_ms", "te_ms") - F.greatest("s_ms", "ts_ms")
    best = F.max(F.struct(overlap.alias("overlap_ms"), (-F.col("ts_ms")).alias("a"), (-F.col("turn_idx")).alias("b"), "speaker")).alias("best")
    keys = [c for c in segments.columns]
    return pair.groupBy(*keys).agg(best).select(*keys, "best.speaker", "best.overlap_ms")


def quality_filter(chunks: DataFrame, least_ms: int = LEAST_MS, most_ms: int = MOST_MS, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Chunks of a fair length and confidence whose text isn't blank; bounds belong to the range."""
    length = F.col("e_ms") - F.col("s_ms")
    return chunks.where(length.between(least_ms, most_ms) & (F.col("confidence") >= least_confidence) & (F.trim("text") != ""))


def summarize_speakers(chunks: DataFrame, *by: str) -> DataFrame:
    """Seconds, chunks, mean length and tier of each speaker; sums are of whole milliseconds, so tiers never flip."""
    by = by or ("source_id", "speaker")
    length = F.col("e_ms") - F.col("s_ms")
    g = chunks.groupBy(*by).agg(F.sum(length).alias("ms"), F.count("*").alias("chunk_count"))
    return g.select(*by, (F.col("ms") / 1000).alias("total_seconds"), "chunk_count", F.round(F.col("ms") / 1000 / F.col("chunk_count"), 6).alias("mean_chunk_seconds"), S.quality_tier(F.col("ms") / 1000).alias("quality_tier"))


def export_filter(chunks: DataFrame, speaker: str, character: str | None = None) -> DataFrame:
    """One speaker's chunks, of one character if named. An empty result is an error that names what there is."""
    mine = chunks.where(F.col("speaker") == speaker)
    if character is not None:
        mine = mine.where(F.col("character") == character)
    if mine.isEmpty():
        seen = [r[0] for r in chunks.select("speaker").distinct().orderBy("speaker").limit(50).collect()]
        if character is not None and chunks.where(F.col("character").isNotNull()).isEmpty():
            raise ValueError("chunks have no character labels")
        raise ValueError(f"no chunks of {speaker}/{character}; speakers: {seen}")
    return mine


def merge_islands(turns: DataFrame, key: str, label: str, start: str, end: str, order: Sequence[str], joins: Column) -> DataFrame:
    """Runs of neighbouring rows with one label, in order, that ``joins`` (of ``reach``, the run's end so far, and start) lets grow
    together. A label's run breaks where another label stands between."""
    w = W.partitionBy(key).orderBy(*order)
    run = turns.withColumn("new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    inside = W.partitionBy(key, "run").orderBy(*order)
    reach = run.withColumn("reach", F.max(end).over(inside.rowsBetween(W.unboundedPreceding, -1)))
    parts = reach.withColumn("cut", F.when(F.col("reach").isNull() | ~joins, 1).otherwise(0)).withColumn("island", F.sum("cut").over(inside))
    return parts.groupBy(key, "run", "island", label).agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged"))


def merge_turns(turns: DataFrame, gap_ms: int = TURN_GAP_MS) -> DataFrame:
    return merge_islands(turns, "source_id", "speaker", "ts_ms", "te_ms", ("ts_ms", "turn_idx"), F.col("ts_ms") - F.col("reach") < gap_ms)


def merge_windows(windows: DataFrame, gap_ms: int = WINDOW_GAP_MS) -> DataFrame:
    return merge_islands(windows, "source_id", "label", "ts_ms", "te_ms", ("ts_ms", "label"), F.col("ts_ms") <= F.col("reach") + gap_ms)


def fold_clusters(chunks: DataFrame, *, least_chunks: int, least_seconds: float, most: int | None = None) -> DataFrame:
    """Names of clusters of (speaker, cluster, seconds): the largest is CHAR_A; others with enough chunks and seconds follow
    in order of size, up to ``most`` names; the rest take the largest's name. Returns speaker, cluster, name."""
    g = chunks.groupBy("speaker", "cluster").agg(F.sum("seconds").alias("s"), F.count("*").alias("n"))
    by_size = W.partitionBy("speaker").orderBy(F.desc("s"), F.desc("n"), "cluster")
    g = g.withColumn("rank", F.row_number().over(by_size))
    good = (F.col("rank") == 1) | ((F.col("n") >= least_chunks) & (F.col("s") >= least_seconds))
    g = g.withColumn("good", good).withColumn("no", F.sum(good.cast("int")).over(by_size) - 1)
    if most is not None:
        g = g.withColumn("good", F.col("good") & (F.col("no") < max(1, most)))
    return g.select("speaker", "cluster", F.concat(F.lit("CHAR_"), F.when(F.col("good"), S.char_label(F.col("no"))).otherwise("A")).alias("name"))


#: Vectors of a block: a pair of blocks is one product of two matrices.
BLOCK_ROWS = 1024


def similar_pairs(vectors: DataFrame, most_distance: float, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (a < b) of a speaker's vectors within a cosine distance. A speaker's rows are dealt into blocks of about ``block_rows``, however many there are, and
    each pair of blocks is one task's product of matrices."""
    ways = vectors.groupBy("speaker").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("ways"))
    v = vectors.select("speaker", "idx", F.col("v").cast("array<double>").alias("v")).join(ways, "speaker")
    block = F.pmod(F.xxhash64("idx"), F.col("ways")).cast("int")
    # a block meets itself and those after it
    v = v.withColumn("mine", block)
    left = v.withColumn("p", F.col("mine")).withColumn("q", F.explode(F.sequence(F.col("mine"), F.col("ways") - 1)))
    right = v.toDF(*v.columns).withColumn("q", F.col("mine")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("mine"))))

    def near(x: pa.Table, y: pa.Table) -> pa.Table:
        out = {"speaker": pa.array([], pa.string()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())}
        if len(x) and len(y):
            xi, yi = (t.column("idx").to_numpy() for t in (x, y))
            xv, yv = (np.vstack(t.column("v").to_numpy()) for t in (x, y))
            xv, yv = (m / np.where((n := np.sqrt((m * m).sum(axis=1, keepdims=True))) == 0, 1.0, n) for m in (xv, yv))
            far = 1 - xv @ yv.T
            i, j = np.nonzero(far <= most_distance)
            same = bool(x.column("mine")[0] == y.column("mine")[0])
            keep = xi[i] < yi[j] if same else np.ones(len(i), dtype=bool)
            i, j = i[keep], j[keep]
            out = {"speaker": pa.array([x.column("speaker")[0].as_py()] * len(i), pa.string()), "a": pa.array(np.minimum(xi[i], yi[j])), "b": pa.array(np.maximum(xi[i], yi[j])), "distance": pa.array(far[i, j])}
        return pa.table(out)

    return left.groupBy("speaker", "p", "q").cogroup(right.groupBy("speaker", "p", "q")).applyInArrow(near, "speaker string, a long, b long, distance double")


def connected_labels(vertices: DataFrame, edges: DataFrame, *, most_rounds: int = 200) -> DataFrame:
    """(speaker, idx, root): the smallest member that edges reach. Minima move over the edges and jump to their own
    root, so rounds grow with the logarithm of a chain; lineage is cut each round in the shared folder. Labels that don't settle are an error."""
    spark = vertices.sparkSession
    _need_checkpoint(spark)
    both = edges.select("speaker", "a", "b").union(edges.select("speaker", F.col("b"), F.col("a"))).checkpoint()
    lab = vertices.select("speaker", F.col("idx").alias("v"), F.col("idx").alias("root")).checkpoint()
    for _ in range(most_rounds):
        seen = both.join(lab.select("speaker", F.col("v").alias("b"), F.col("root").alias("r")), ["speaker", "b"]).groupBy("speaker", "a").agg(F.min("r").alias("r"))
        new = lab.join(seen.withColumnRenamed("a", "v"), ["speaker", "v"], "left").select("speaker", "v", F.least("root", F.coalesce("r", "root")).alias("root"))
        jump = new.select("speaker", F.col("v").alias("root"), F.col("root").alias("top"))
        new = new.join(jump, ["speaker", "root"], "left").select("speaker", "v", F.least("root", F.coalesce("top", "root")).alias("root")).checkpoint()
        moved = new.join(lab.withColumnRenamed("root", "was"), ["speaker", "v"]).where("root <> was").limit(1).count()
        lab = new
        if not moved:
            return lab.select("speaker", F.col("v").alias("idx"), "root")
    raise RuntimeError(f"labels did not settle in {most_rounds} rounds")


def complete_linkage(x: np.ndarray, most: float) -> np.ndarray:
    """Labels (0, 1, ... by first member) of rows by complete linkage on cosine distance: clusters merge while the farthest pair of both is nearer than ``most``.
    Nearest-neighbour chains find the merges in quadratic time."""
    n = len(x)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    u = x / np.where(size == 0, 1.0, size)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    live, top, merges, chain = np.ones(n, dtype=bool), np.arange(n), [], []
    while live.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            row = np.where(live, d[a], np.inf)
            b = int(row.argmin())
            # on a tie the one before in the chain, so that chains end
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((float(d[a, b]), a, b))
        keep, gone = min(a, b), max(a, b)
        d[keep] = d[:, keep] = np.maximum(d[keep], d[gone])
        d[keep, keep] = np.inf
        live[gone] = False

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for far, a, b in merges:
        if far < most:
            a, b = sorted((root(a), root(b)))
            top[b] = a
    roots = np.array([root(i) for i in range(n)])
    return np.unique(roots, return_inverse=True)[1]


def cluster_by_threshold(vectors: DataFrame, most: float, *, key: str = "source_id") -> DataFrame:
    """(key, idx, cluster): each recording's vectors by complete linkage. All distances within a recording count, so a recording is one task, of as many
    vectors as it has windows."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        return pd.DataFrame({key: rows[key], "idx": rows["idx"], "cluster": complete_linkage(np.vstack(rows["v"].to_numpy()), most)})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "idx", F.col("v").cast("array<double>").alias("v")).groupBy(key).applyInPandas(one, f"{key} {kind}, idx long, cluster long")


def cluster_by_number(vectors: DataFrame, k: int, *, starts: int = 10, seed: int = 0) -> DataFrame:
    """(idx, cluster): k-means from several starts, the best by the sum of squares; with fewer rows than ``k`` all are in cluster 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if vectors.limit(k).count() < k:
        return vectors.select("idx", F.lit(0).alias("cluster"))
    v = vectors.select("idx", array_to_vector(F.col("v").cast("array<double>")).alias("features")).persist()
    models = [KMeans(k=k, seed=seed + i, initMode="k-means||").fit(v) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(v).select("idx", F.col("prediction").alias("cluster"))
    v.unpersist()
    return out


def undersplit(named: DataFrame, *, least_chunks: int = 50, most_characters: int = 1) -> DataFrame:
    """Speakers with many chunks (speaker, name) that all fell to so few characters that clustering may have merged several: speaker, chunks, characters."""
    g = named.groupBy("speaker").agg(F.count("*").alias("chunks"), F.count_distinct("name").alias("characters"))
    return g.where((F.col("chunks") >= least_chunks) & (F.col("characters") <= most_characters))


def orphans(files: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Files whose key isn't wanted any more, each once."""
    return files.join(wanted.select(key).distinct(), key, "left_anti").distinct()


def _need_checkpoint(spark) -> None:
    """The session's shared checkpoint folder; a temporary one only where none is set, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="weftline-"))


def first_seen_labels(rows: DataFrame) -> DataFrame:
    """Roots as 0, 1, ... in the order of their first member."""
    return rows.withColumn("label", F.dense_rank().over(W.partitionBy("speaker").orderBy("root")) - 1)


def pick_reference(chunks: DataFrame, top: int = 3) -> DataFrame:
    """The best clips of each speaker by penalties: rank, score, tags. Scores are of whole milliseconds; ties go by order."""
    end = chunks.groupBy("source_id").agg(F.max("e_ms").alias("source_ms"))
    c = chunks.join(end, "source_id")
    length = F.col("e_ms") - F.col("s_ms")
    short, long = length < CLIP_LEAST, length > CLIP_MOST
    dur = F.when(short, CLIP_LEAST - length).when(long, length - CLIP_MOST).otherwise(0)
    intro, outro = F.col("s_ms") < CLIP_GUARD, F.col("e_ms") > F.col("source_ms") - CLIP_GUARD
    place = F.when(intro, CLIP_GUARD - F.col("s_ms")).otherwise(0) + F.when(outro, F.col("e_ms") - F.col("source_ms") + CLIP_GUARD).otherwise(0)
    tags = S.text_penalties(F.col("text"))
    all_tags = F.concat(F.array_compact(F.array(F.when(short, "too_short").when(long, "too_long"), F.when(intro, "intro"), F.when(outro, "outro"))), tags)
    score = (W_DURATION * dur + W_PLACE * place) / 1000 + W_TEXT * F.size(tags)
    w = W.partitionBy("source_id", "speaker").orderBy("score", "seg_idx")
    return c.withColumn("score", F.round(score, 6)).withColumn("penalties", F.array_join(all_tags, ",")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def rebalance(clips: DataFrame, target: int | None = None, *, by: str = "emotion", seed: int = 42, rows_per_cell: int = 4096) -> DataFrame:
    """Every class as often as ``target`` (the largest class): larger ones lose rows drawn by a hash, smaller ones
    repeat rows drawn by a hash. Returns the clips with ``copy``. A class is numbered within cells of its hash, whose sizes are summed before it,
    so none is sorted in one task."""
    sizes = clips.groupBy(by).agg(F.count("*").alias("n"))
    want = F.lit(target) if target is not None else F.lit(sizes.agg(F.max("n")).first()[0])
    sizes = sizes.withColumn("target", want.cast("long")).withColumn("cells", F.ceil(F.col("n") / rows_per_cell))
    h = F.xxhash64(F.lit(seed), "clip_id")
    t = clips.withColumn("h of it", h).join(sizes, by).withColumn("cell", F.least(F.floor((F.col("h of it") / 2.0**64 + 0.5) * F.col("cells")), F.col("cells") - 1))
    before = W.partitionBy(by).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    base = t.groupBy(by, "cell").agg(F.count("*").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    no = F.col("base") + F.row_number().over(W.partitionBy(by, "cell").orderBy("h of it", "clip_id")) - 1
    rows = t.join(base, [by, "cell"]).withColumn("no", no).drop("h of it", "cell", "cells", "base")
    down = rows.where("no < target").withColumn("copy", F.lit(0))
    draws = sizes.where("n < target").select(by, "n", F.explode(F.sequence(F.lit(1), (F.col("target") - F.col("n")).cast("int"))).alias("copy"))
    draws = draws.select(by, "copy", F.pmod(F.xxhash64(F.lit(seed), by, "copy"), F.col("n")).alias("no"))
    up = rows.drop("copy").join(draws, [by, "no"])
    return down.unionByName(up.select(*down.columns)).drop("no", "n", "target")


def stride_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spread: numbers floor(k n / most)."""
    w = W.partitionBy(key)
    r = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("size", F.count("*").over(w))
    wanted = F.floor(F.ceil(F.col("i") * most / F.col("size")) * F.col("size") / most)
    return r.where((F.col("size") <= most) | (wanted == F.col("i")))


#: Sentences of a source from which on the likeness of unmatched segments is found apart from its one pass, and about how many are compared at a time.
CELL_SENTENCES = 512


def realign(segments: DataFrame, sentences: DataFrame, *, least: float = 0.6, window: int = 50, cell: int = CELL_SENTENCES) -> DataFrame:
    """Each segment's text replaced by the likest sentence of its source, near the last one found first; (source_id, seg_idx, text)
    against (source_id, n, sentence). Sequential by nature, so one source is one pass of one task. Of a source of more than ``cell`` sentences the pass only settles
    what is replaced; the ratios of the other segments need all its sentences, and are found by cells of them."""
    from weftline.functions.matching import Candidates

    _need_checkpoint(segments.sparkSession)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, refs, likest, last = object(), [], None, None
        for b in batches:
            out = []
            for key, kind, n, text in zip(*(c.to_pylist() for c in b.columns)):
                if key != source:
                    source, refs, likest, last = key, [], None, None
                if kind == 0:
                    refs.append(text)
                    continue
                likest = Candidates(refs) if likest is None else likest
                size = len(refs)
                near = (0, size) if last is None or window <= 0 else (max(0, last - window), min(last + window + 1, size))
                # no sentence stands for one of just less than the least ratio
                found, ratio = likest.best(text, *near, (size, least)) if near != (0, size) else (size, least)
                if found == size and size > cell and key is not None and n is not None:
                    found, ratio = likest.best(text, 0, size, (size, least))
                    ratio = ratio if found < size else None
                elif found == size:
                    found, ratio = likest.best(text)
                good = ratio is not None and 0 <= found < size and ratio >= least
                last = found if good else last
                out.append((key, n, refs[found] if good else text, None if ratio is None else float(round(ratio, 6)), good))
            yield _arrow(out, schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, refs, likest = object(), [], None
        for b in batches:
            out = []
            for key, part, kind, n, text in zip(*(c.to_pylist() for c in b.columns)):
                if (key, part) != at:
                    at, refs, likest = (key, part), [], None
                if kind == 0:
                    refs.append(text)
                    continue
                likest = Candidates(refs) if likest is None else likest
                out.append((key, n, text, float(round(likest.best(text)[1], 6))))
            yield _arrow(out, schema.remove(schema.get_field_index("replaced")))

    schema = pa.schema([("source_id", pa.int64()), ("seg_idx", pa.int64()), ("text", pa.string()), ("ratio", pa.float64()), ("replaced", pa.bool_())])
    segs = segments.select(F.col("source_id").cast("long").alias("source_id"), F.lit(1).alias("kind"), F.col("seg_idx").cast("long").alias("n"), "text")
    refs = sentences.select(F.col("source_id").cast("long").alias("source_id"), F.lit(0).alias("kind"), F.col("n").cast("long").alias("n"), F.col("sentence").alias("text"))
    rows = _dealt(refs.unionByName(segs), "source_id").sortWithinPartitions("source_id", "kind", "n", "text")
    done = rows.mapInArrow(follow, "source_id long, seg_idx long, text string, ratio double, replaced boolean").checkpoint()
    rest = done.where("ratio IS NULL").drop("ratio", "replaced").distinct()
    if rest.isEmpty():
        return done
    wanted = refs.where(F.col("text").isNotNull()).select("source_id", "text").join(rest.select("source_id").distinct(), "source_id", "left_semi").distinct()
    ways = wanted.groupBy("source_id").agg(F.ceil(F.count("*") / cell).cast("int").alias("ways"))
    r = wanted.join(ways, "source_id").select("source_id", F.pmod(F.xxhash64("text"), "ways").cast("int").alias("cell"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("n"), "text")
    s = rest.join(ways, "source_id").select("source_id", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("cell"), F.lit(1).alias("kind"), F.col("seg_idx").alias("n"), "text")
    cells = _dealt(r.unionByName(s), "source_id", "cell").sortWithinPartitions("source_id", "cell", "kind")
    ratios = cells.mapInArrow(compare, "source_id long, seg_idx long, text string, ratio double").groupBy("source_id", "seg_idx", "text").agg(F.max("ratio").alias("ratio"))
    late = done.where("ratio IS NULL").drop("ratio").join(ratios, ["source_id", "seg_idx", "text"])
    return done.where("ratio IS NOT NULL").unionByName(late)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by keys in several partitions a core at least, for work that costs far more than its bytes tell."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def fuzzy_matches(texts: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """(key, index, ratio) of the likest of a short list of candidates, the first of equals."""
    from weftline.functions.matching import Candidates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        likest = Candidates(candidates)
        for b in batches:
            got = [likest.best(t) for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "index": [g[0] for g in got], "ratio": [g[1] for g in got]})

    return texts.select("key", "text").mapInPandas(run, "key long, index int, ratio double")
