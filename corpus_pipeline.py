"""A corpus pipeline of five operators: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm import decontam, mixing, ngram_join, sharding, toxicity
from weftline.llm.store import discard, sized, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names that no column of documents has.
KEY, TEXT_KEY = "join key of the stage", "text key of the stage"


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").alias(KEY), F.col("text_key").alias(TEXT_KEY))


def _apart(docs: DataFrame, keys: DataFrame, key: Column, how: str) -> DataFrame:
    """Documents by whether their id and text (as ``key``) are among ``keys``; a null id equals a null id. Few keys are broadcast, many are shuffled."""
    return docs.join(sized(keys, 200_000), F.col("doc_id").eqNullSafe(F.col(f"`{KEY}`")) & (key == F.col(f"`{TEXT_KEY}`")), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of at least one half go; null and empty texts stay. Every row is judged by its text alone, so repeated rows
    and ties go or stay together; other columns are neither read nor sent to Python."""
    toxic = toxicity.toxic_column(spark, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return docs.where(~toxic(F.col("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join the document with the smallest id stays (a null id is the largest; of texts under one id, one);
    of rows with one id and text, one. Null and blank texts are linked with nothing and all stay."""
    key = F.xxhash64(F.col("text").cast("string"))
    groups = written(ngram_join.near_groups(docs, key=key), "stage-groups")
    linked = groups.where("component is not null")
    stay = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("k")).select("k.doc_id", "k.text_key")
    stay = written(_keys(stay), "stage-stay")
    # grouped, not joined to themselves: rows of one id and text are one key
    seen = written(linked.groupBy("doc_id", "text_key").count(), "stage-seen")
    away = written(_keys(_apart(seen, stay, F.col("text_key"), "left_anti")), "stage-away")
    left = _apart(docs, away, key, "left_anti")
    again = written(_keys(seen.where("count > 1")), "stage-again")
    if again.isEmpty():
        return left
    twice = _apart(left, again, key, "left_semi").dropDuplicates(["doc_id", "text"])
    return _apart(left, again, key, "left_anti").unionByName(twice)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase of one, go; null and empty texts stay. Every row is judged by its text alone, and
    other columns are neither read nor sent to Python."""
    for i, part in enumerate(decontam.in_parts(_table(spark, sf_dir, "benchmark"))):
        docs = written(docs, "stage-part") if i else docs  # one part's model on the executors at a time
        hit = decontam.contaminated_column(spark, decontam.fit(docs, part))
        docs = docs.where(~hit(F.col("text")))
    return docs


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times, in the order of the mix: by shard, shuffled within. Those that it
    doesn't take go, null and empty texts among them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their size, text_crc32, shard (of 40, near equal bytes) and slot; copies of a document have one slot each.
    Columns of these names that documents bring along go on as ``<name>_before``."""
    found = ["size", "text_crc32", "shard", "slot"]
    placed = sharding.shard_by_size(docs, 40)
    a = docs.select(*[F.col(f"`{c}`").alias(f"{c}_before" if c in found else c) for c in docs.columns])
    rows = a.columns
    # rows of one id are told apart by their text: both sides count within id and checksum, shorter texts first
    crc = F.crc32(F.col("text").cast("binary"))
    a = a.withColumn(TEXT_KEY, crc).withColumn("n of it", F.row_number().over(W.partitionBy("doc_id", F.col(f"`{TEXT_KEY}`")).orderBy(F.octet_length("text"), "text")))
    nth = F.row_number().over(W.partitionBy("doc_id", "text_crc32").orderBy("size", "shard", "slot"))
    b = written(placed.select(F.col("doc_id").alias(KEY), *found, nth.alias("n of its place")), "stage-slots")
    same = F.col("doc_id").eqNullSafe(F.col(f"`{KEY}`")) & F.col(f"`{TEXT_KEY}`").eqNullSafe(F.col("text_crc32")) & (F.col("`n of it`") == F.col("`n of its place`"))
    return a.join(sized(b, 200_000), same).select(*[f"`{c}`" for c in rows], *found)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: SQL can't express the trained and iterative stages; tests hold each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)  # the stage has read it
        before = docs
    return docs
