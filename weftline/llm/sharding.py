"""Sharding by sampled splitters, with DataFrame functions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.store import written

#: Second-level order of the records of a range that are not of a hot key.
_REST = 1 << 20


def _unit(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def _splitters(slim: DataFrame, total: int, ranges: int, draws: int, seed: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample: each record is drawn ``size / step`` times,
    rounded at random, so about ``draws`` keys are gathered however large the input is."""
    step = total / draws
    drawn = F.floor(F.col("size") / step + _unit(F.col("doc_id"), F.col("h"), seed=seed)).cast("int")
    sample = slim.select("h", drawn.alias("n")).where("n > 0").select(F.explode(F.array_repeat("h", F.col("n"))).alias("h"))
    row = (
        sample.agg(F.sort_array(F.collect_list("h")).alias("a"))
        .where(F.size("a") > 0)
        .select(F.expr(f"transform(sequence(1, {ranges - 1}), i -> a[cast(floor(i * size(a) / {ranges}) as int)])").alias("cut"))
        .first()
    )
    return list(row["cut"]) if row else []


def shard_by_size(
    docs: DataFrame,
    n_shards: int = 40,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    ranges_per_shard: int = 8,
    draws_per_range: int = 16,
    whole_group_share: float = 0.05,
    seed: int = 17,
) -> DataFrame:
    """Deal all records over ``n_shards`` shards of near equal bytes.

    A record's size is its text's UTF-8 bytes (null: 0) plus ``overhead``. Records are ordered by a hash of
    their text, so equal texts lie together. A size-weighted sample of keys gives the splitters of
    ``n_shards * ranges_per_shard`` ranges. A key that several splitters share is hot: its records are dealt over
    sub-ranges by a hash of id and row. A range whose measured bytes still exceed twice the mean is subdivided by key. Exact
    bytes of all ranges, summed in order, give each record its place in the total, and the place its shard.

    Law: sizes near equal. Equal texts share a shard unless their group has more than ``whole_group_share`` of a
    shard's bytes; such a group may be cut where a shard ends. (A group that stays whole moves a shard's edge by up to half its bytes, so this share is
    also how far a shard may be from the mean.) Null and empty texts are two groups of their own.
    Repeated rows are kept, each with a slot of its own. An empty table gives an empty result.

    Returns id, size, text_crc32, shard, slot (0, 1, ... within the shard).
    """
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), text.isNull(), text).alias("h"),
    )
    # a number of the row itself tells equal rows apart where a hot text is cut; it is written once and then read
    slim = written(slim.withColumn("rid", F.monotonically_increasing_id()), "shard-keys")
    total, rows = slim.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return slim.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    ranges = max(2, n_shards * ranges_per_shard)
    cuts = Counter(_splitters(slim, total, ranges, ranges * draws_per_range, seed))
    hot = {key: 2 * n for key, n in cuts.items() if n > 1}
    bounds = F.array(*[F.lit(x) for x in sorted(cuts)]).cast("array<bigint>")
    ranged = slim.withColumn("range", F.size(F.filter(bounds, lambda b: b <= F.col("h"))))
    sub = F.lit(_REST)
    if hot:
        parts = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
        ways = F.try_element_at(parts, F.col("h"))
        sub = F.when(ways.isNotNull(), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "rid"), ways).cast("int")).otherwise(sub)
    ranged = ranged.withColumn("sub", sub)

    # at most ``ranges`` ranges and twice as many parts of hot keys: a table of a fixed size
    mean = total / ranges
    over = ranged.groupBy("range", "sub").agg(F.sum("size").alias("b")).where(F.col("b") > 2 * mean).select("range", "sub", F.ceil(F.col("b") / mean).cast("int").alias("ways"))
    ranged = (
        ranged.join(F.broadcast(over), ["range", "sub"], "left")
        .withColumn("part", F.when(F.col("ways").isNull(), 0).when(F.col("sub") < _REST, F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "rid"), F.col("ways"))).otherwise(F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.col("ways"))).cast("int"))
        .drop("ways")
    )
    cell = ["range", "sub", "part"]
    before = W.orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy(*cell).agg(F.sum("size").alias("b"), F.count("*").alias("n")).select(*cell, F.coalesce(F.sum("b").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"))

    inside = W.partitionBy(*cell).orderBy("h", "doc_id", "rid").rowsBetween(W.unboundedPreceding, W.currentRow)
    group = W.partitionBy(*cell, "h")
    placed = (
        ranged.withColumn("run", F.sum("size").over(inside))
        .withColumn("row", F.row_number().over(W.partitionBy(*cell).orderBy("h", "doc_id", "rid")))
        .withColumn("g_bytes", F.sum("size").over(group))
        .withColumn("g_end", F.max("run").over(group))
        .join(F.broadcast(starts), cell)
    )
    whole = (F.col("g_bytes") <= whole_group_share * total / n_shards) & (F.col("sub") == _REST)
    middle = F.col("byte0") + F.when(whole, F.col("g_end") - F.col("g_bytes") / 2).otherwise(F.col("run") - F.col("size") / 2)
    placed = placed.select("doc_id", "size", "text_crc32", F.least(F.floor(middle * n_shards / total), F.lit(n_shards - 1)).cast("int").alias("shard"), (F.col("row0") + F.col("row")).alias("at"))
    first = placed.groupBy("shard").agg(F.min("at").alias("at0"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("at0")).cast("long").alias("slot"))
