"""Places in a global order without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def placed(rows: DataFrame, first: Column, *then: str, prefix: int = 8, ways: int = 64, out: str = "place") -> DataFrame:
    """``rows`` with their place (1, 2, ...) in the order of ``first`` (a string, nulls first) and ``then`` (numbers that differ, as ids do).

    Rows are ranked within cells: the first signs of the string, and ranges of the first of ``then`` where the string is the same for all of a cell. Only the cells' sizes are
    summed in one task; a hot string is as many cells as there are ranges."""
    key = F.coalesce(first, F.lit(""))
    t = rows.withColumn("key of it", key).withColumn("null of it", first.isNotNull())
    lo, hi = rows.agg(F.min(then[0]), F.max(then[0])).first()
    span = max(1, ((hi or 0) - (lo or 0)) // ways + 1)
    head = F.substring("key of it", 1, prefix)
    # a cell of one string is cut by the number, one of several isn't
    alone = t.groupBy("null of it", head.alias("head")).agg((F.min("key of it") == F.max("key of it")).alias("alone"))
    t = t.withColumn("head", head).join(alone, ["null of it", "head"])
    t = t.withColumn("range", F.when(F.col("alone"), F.floor((F.col(then[0]) - (lo or 0)) / span)).otherwise(0))
    cell = ["null of it", "head", "range"]
    before = W.orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)
    sizes = t.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(W.partitionBy(*cell).orderBy("key of it", *then))
    return t.join(sizes, cell).withColumn(out, (F.col("base") + rank).cast("long")).select(*[F.col(f"`{c}`") for c in rows.columns], out)
