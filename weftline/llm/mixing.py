"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.store import sized, written

WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 3.0) -> list[float]:
    """Targets in proportion to ``weights`` that sum to ``total``; none above ``most`` times its size,
    the excess shared anew by weight until none is above (or all are full)."""
    target, full, left = [0.0] * len(sizes), set(), float(total)
    while True:
        live = [i for i in range(len(sizes)) if i not in full]
        share = sum(weights[i] for i in live)
        if not live or share <= 0:
            return target
        for i in live:
            target[i] = left * weights[i] / share
        over = [i for i in live if target[i] > most * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = most * sizes[i]
            full.add(i)
            left -= target[i]


def split_tree(quotas: Sequence[int], n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard (sources x shards), whose rows sum to ``quotas``.

    Each node of a binary tree over the shards splits its vector of block counts in one multivariate
    hypergeometric draw, seeded by the node alone, so reruns and single shards agree."""
    out = np.zeros((len(quotas), n_shards), dtype=np.int64)

    def down(lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = counts
            return
        mid, all_ = (lo + hi) // 2, int(counts.sum())
        take = round(all_ * (mid - lo) / (hi - lo))
        rng = np.random.Generator(np.random.Philox(key=[seed, (lo << 32) | hi]))
        left = rng.multivariate_hypergeometric(counts, take, method="marginals") if all_ else counts * 0
        down(lo, mid, left)
        down(mid, hi, counts - left)

    down(0, n_shards, np.asarray(quotas, dtype=np.int64))
    return out


def _stride(n: int, seed: int) -> int:
    """A number without a common divisor with ``n``, so that multiples of it permute 0 .. n - 1."""
    k = max(1, int(n * 0.618)) + seed % 7
    while gcd(k, n) > 1:
        k += 1
    return k


def mix_plan(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3.0,
    n_shards: int = 16,
    blocks_per_shard: int = 64,
    rows_per_cell: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 23,
) -> DataFrame:
    """One row per document: what the mix takes of it, and where each copy goes.

    Size: words of the text (null: 0). Sources by code point, null last, weigh ``weights`` in turn; targets share
    the sum of all sizes (see ``water_fill``). A source's target is cut into blocks of equal length, a whole number of them: its exact quota. The
    splitting tree deals all quotas over the shards, and each shard draws its run of the source's permuted blocks, so draws are disjoint.
    A source's documents are permuted by a hash and laid end to end, epoch after epoch; a copy belongs to the block that holds its middle word, and is
    taken if a shard drew that block. Places on the line come from sums over hash cells of about ``rows_per_cell`` rows, so no source is
    ever in one task. The driver holds one row per source and shard, nothing that grows with documents.

    Empty texts have size 0 and are never taken; a null source is a source; rows with one id are told apart by their text, and equal ones lie
    next to each other, each with a place of its own; an empty table gives an empty result. Returns doc_id, text_key (a hash of the text),
    source, size, source_size, target, copies, taken, places (an array of copy, block, shard, shuffle key)."""
    text = F.col(text_col).cast("string")
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    slim = written(slim.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "text_key")), "mix-sizes")
    found = slim.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["s"]) for r in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], sum(sizes), most)
    about = max(64, -(-sum(sizes) // max(1, n_shards * blocks_per_shard)))
    quotas = [max(1, round(t / about)) if t > 0 else 0 for t in targets]
    tree = split_tree(quotas, n_shards, seed)
    rows = [
        (r["source"], n, t, max(1, -(-r["n"] // rows_per_cell)), max(q, 1), t / q if q else 1.0, _stride(max(q, 1), seed), [int(x) for x in np.cumsum(tree[i])])
        for i, (r, n, t, q) in enumerate(zip(found, sizes, targets, quotas, strict=True))
    ]
    spark = docs.sparkSession
    facts = spark.createDataFrame(rows, "fsource string, source_size long, target double, cells long, quota long, block double, stride long, ends array<bigint>").coalesce(1)

    # the table of sources has one row each; Spark broadcasts it if it is small and shuffles it otherwise
    on = slim.join(facts, F.col("source").eqNullSafe(F.col("fsource"))).drop("fsource")
    on = on.withColumn("cell", F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * F.col("cells")), F.col("cells") - 1).cast("int"))
    cells = on.groupBy("source", "cell").agg(F.sum("size").alias("s"))
    before = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("csource"), F.col("cell").alias("ccell"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    run = W.partitionBy("source", "cell").orderBy("h", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    line = on.withColumn("run", F.sum("size").over(run)).join(cells, F.col("source").eqNullSafe(F.col("csource")) & (F.col("cell") == F.col("ccell")))
    line = line.withColumn("start", F.col("base") + F.col("run") - F.col("size"))
    middle = lambda e: e * F.col("source_size") + F.col("start") + F.col("size") / 2.0
    # a source without a quota has no block that a shard drew; a middle on the very end of the line belongs to the last block
    block = lambda e: F.when(middle(e) <= F.col("target"), F.least(F.floor(middle(e) / F.col("block")), F.col("quota") - 1))
    drawn = lambda b: F.size(F.filter("ends", lambda x: x <= (b * F.col("stride")) % F.col("quota")))
    place = lambda e: F.struct(e.cast("int").alias("copy"), block(e).alias("block"), drawn(block(e)).alias("shard"), F.xxhash64(F.lit(seed + 1), "doc_id", "text_key", e).alias("shuffle_key"))
    epochs = F.array(*[F.lit(e) for e in range(int(np.ceil(most)))])
    places = F.filter(F.transform(epochs, place), lambda p: p["block"].isNotNull() & (p["shard"] < n_shards))
    line = line.withColumn("places", F.when(F.col("size") > 0, places).otherwise(F.filter(F.transform(epochs, place), lambda p: F.lit(False))))
    copies = F.size("places").cast("long")
    return line.select("doc_id", "text_key", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "places")


def mixed(plan: DataFrame) -> DataFrame:
    """One row per copy that the mix takes: doc_id, text_key, source, copy, block, shard and the key of the shuffle within the shard."""
    return plan.select("doc_id", "text_key", "source", F.explode("places").alias("p")).select("doc_id", "text_key", "source", "p.*")


def mixed_documents(docs: DataFrame, *, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, by shard and shuffled within it: partitions hold slices of a shard in the order of
    the shuffle key. Rows are joined to the plan by id, source and text; rows that agree in all three are taken equally often. Columns are those of
    ``docs``, whatever their names; documents that the mix doesn't take, null and empty texts among them, go."""
    plan = mix_plan(docs, n_shards=n_shards, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
    plan = plan.groupBy("doc_id", "source", "text_key").agg(F.max_by("places", "copies").alias("places"))
    plan = written(plan, "mix-copies")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    field = lambda c: F.col("row").getField(c)
    same = field(id_col).eqNullSafe(F.col("doc_id")) & field(source_col).cast("string").eqNullSafe(F.col("source")) & (F.xxhash64(field(text_col).cast("string")) == F.col("text_key"))
    out = row.join(sized(plan, 200_000), same).select("row", F.explode("places").alias("p"))
    # a shard is as many slices as there are partitions for it
    ways = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_shards))
    unit = F.col("p.shuffle_key") / 2.0**64 + 0.5
    out = out.select("row", F.col("p.shard").alias("shard"), F.least(F.floor(unit * ways), F.lit(ways - 1)).alias("slice"), F.col("p.shuffle_key").alias("k"))
    return out.repartition(n_shards * ways, "shard", "slice").sortWithinPartitions("shard", "slice", "k").select("row.*")
