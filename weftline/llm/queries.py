"""The thin queries over the ten operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import ann, chat, decontam, language, mixing, ngram_join, quality, sharding, toxicity, warc
from weftline.llm.features import fold_of


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_size(_read(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", F.col("places.shard").alias("shards"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "part", "place")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    return chat.rendered(turns, chat.maximal_conversations(turns))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.all_matches(docs, _read(spark, sf_dir, "benchmark"))
    best = F.try_element_at("hits", F.lit(1))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.col("hits.item_id").alias("item_ids"), best["item_id"].alias("item_id"), best["lcs"].alias("lcs"), best["cosine"].alias("cosine"), best["answer"].alias("answer"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.size("segments").alias("n_passages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = _read(spark, sf_dir, "labels").select("doc_id", quality.grade_column().alias("grade"))
    out = quality.score(docs, quality.fit(docs, ratings))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_grade", "tail_prob", "selected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sharding, op2_mixing, op3_warc, op4_language_id, op5_chat_formatting, op6_ngram_jaccard, op7_decontamination, op8_ann, op9_toxicity, op10_quality)
    return {f.__name__: f for f in ops}
