"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import discard, written


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 32)))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(v, c) for every vertex of an edge, c being the smallest vertex of its component.

    Each step aggregates neighbours' minima (combined before the shuffle) and rewrites the edges to point at them; edges are
    written to the shared folder after each round. Nothing is gathered on the driver but a count and a checksum.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = start = written(e, "cc")
    was = _state(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        before, e = start, written(e, "cc")
        start = e
        discard(before)
        now = _state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("v"), F.col("v").alias("c")).union(e.select("v", F.col("v").alias("c")).distinct())
