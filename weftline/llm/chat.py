"""Chat formatting: logged snapshots of one conversation collapse into the longest, which is then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.store import written

_HALF = 1 << 32


def _marks(ordinal: Column, role: Column, text: Column, seeds: tuple[int, ...]) -> list[Column]:
    """Halves of hashes of (place, role, text). Sums of halves can't overflow, and don't depend on the order of adding."""
    out = []
    for s in seeds:
        h = F.xxhash64(F.lit(s), ordinal, role.isNull(), role, text.isNull(), text)
        out += [F.shiftrightunsigned(h, 32), F.pmod(h, F.lit(_HALF))]
    return out


def maximal_conversations(turns: DataFrame, *, rows_per_piece: int = 1024, seeds: tuple[int, ...] = (3, 11)) -> DataFrame:
    """Conversations that are no prefix of a longer one: conv_id, n_turns, n_equal (ids of the same content, itself
    included). Of conversations with equal turns the smallest id stays.

    Turns are ordered by (turn, role, text), nulls first, and numbered. A prefix's hash is the sum of the
    hashes of its (number, role, text), so it rolls on by one addition per turn. Proper prefixes of all conversations are anti-joined
    with whole conversations. A conversation of any length is summed in pieces of ``rows_per_piece`` turn values,
    so one that holds a third of all rows isn't one task's. Null ids form one conversation; an empty table
    gives an empty result; null roles and texts differ from empty ones.
    """
    part = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / rows_per_piece)
    t = turns.select("conv_id", "turn", "role", "text", part.cast("long").alias("part"))
    # numbers of turns: the number within a part plus the rows of the parts before
    sizes = t.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    keyed = t.withColumn("row", F.row_number().over(inside))
    same = lambda a, b: F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))
    keyed = keyed.alias("a").join(base.alias("b"), same("conv_id", "conv_id") & (F.col("a.part") == F.col("b.part"))).select("a.*", (F.col("base") + F.col("row")).alias("k"))
    marks = _marks(F.col("k"), F.col("role"), F.col("text"), seeds)
    names = [f"m{i}" for i in range(len(marks))]
    keyed = written(keyed.select("conv_id", "part", "k", *[m.alias(n) for m, n in zip(marks, names, strict=True)]), "chat-turns")

    run = W.partitionBy("conv_id", "part").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    tot = keyed.groupBy("conv_id", "part").agg(*[F.sum(n).alias(n) for n in names])
    base = tot.select("conv_id", "part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"b{n}") for n in names])
    sums = keyed.select("conv_id", "part", "k", *[F.sum(n).over(run).alias(n) for n in names])
    sums = sums.alias("a").join(base.alias("b"), same("conv_id", "conv_id") & (F.col("a.part") == F.col("b.part"))).select("a.conv_id", "k", *[(F.col(n) + F.col(f"b{n}")).alias(n) for n in names])
    whole = tot.join(sizes.groupBy("conv_id", "part").agg(F.max("n").alias("n")).withColumnRenamed("conv_id", "c2").withColumnRenamed("part", "p2"), F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2")))
    whole = whole.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), *[F.sum(n).alias(n) for n in names])
    content = whole.groupBy("n_turns", *names).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))

    ends = whole.select(F.col("conv_id").alias("c2"), "n_turns")
    proper = sums.join(ends, F.col("conv_id").eqNullSafe(F.col("c2"))).where("k < n_turns").select(F.col("k").alias("n_turns"), *names).distinct()
    return content.join(proper, ["n_turns", *names], "left_anti").select("conv_id", "n_turns", "n_equal")


def rendered(turns: DataFrame, kept: DataFrame, *, piece_turns: int = 1024) -> DataFrame:
    """The kept conversations as chat markup: conv_id, piece, n_turns, n_equal, chat. Conversations of more than
    ``piece_turns`` turns come in pieces, to be read in order, so that no group is without a bound.
    Null roles are written as ``unknown``, null texts as nothing; repeated rows are written as often as they are logged."""
    k2 = kept.select(F.col("conv_id").alias("kid"), "n_turns", "n_equal")
    t = turns.select("conv_id", "turn", "role", "text").join(k2, F.col("conv_id").eqNullSafe(F.col("kid")))
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    one = F.struct("turn", "role", "text", line.alias("line"))
    t = t.withColumn("piece", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / piece_turns).cast("long"))
    g = t.groupBy("conv_id", "piece").agg(F.first("n_turns").alias("n_turns"), F.first("n_equal").alias("n_equal"), F.array_sort(F.collect_list(one)).alias("a"))
    return g.select("conv_id", "piece", "n_turns", "n_equal", F.array_join(F.transform("a", lambda x: x["line"]), "").alias("chat"))
