"""Speech records, logs and frames derived from the driver's tables; the SQL twins are for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import spread, table

#: Event types that count as transcript segments.
SEGMENT_TYPES = ("click", "view")
#: Emotions dealt over events.
EMOTIONS = ("neutral", "neutral", "neutral", "angry", "happy", "sad", "unknown")


def _ms(id_col: str = "event_id"):
    e = F.col(id_col)
    return F.floor(e / 20) * 2000 + (e * 37) % 1500


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, seg_idx, s_ms, e_ms, text, confidence."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where(F.col("event_type").isin(*SEGMENT_TYPES)).select(
        (e % 20).alias("source_id"), e.alias("seg_idx"), _ms().alias("s_ms"), (_ms() + 500 + (e * 7919) % 40000).alias("e_ms"), F.col("event_type").alias("text"), (((e * 31) % 101) / 100.0).alias("confidence")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, turn_idx, ts_ms, te_ms, speaker."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where(~F.col("event_type").isin(*SEGMENT_TYPES)).select(
        (e % 20).alias("source_id"), e.alias("turn_idx"), _ms().alias("ts_ms"), (_ms() + 1000 * (1 + e % 30)).alias("te_ms"), F.concat(F.lit("SPEAKER_"), F.lpad((F.col("user_id") % 6).cast("string"), 2, "0")).alias("speaker")
    )


SEGMENTS_SQL = """seg AS (SELECT event_id % 20 AS source_id, event_id AS seg_idx, (event_id // 20) * 2000 + (event_id * 37) % 1500 AS s_ms,
  (event_id // 20) * 2000 + (event_id * 37) % 1500 + 500 + (event_id * 7919) % 40000 AS e_ms, event_type AS text, ((event_id * 31) % 101) / 100.0::DOUBLE AS confidence
  FROM events WHERE event_type IN ('click', 'view'))"""
TURNS_SQL = """turn AS (SELECT event_id % 20 AS source_id, event_id AS turn_idx, (event_id // 20) * 2000 + (event_id * 37) % 1500 AS ts_ms,
  (event_id // 20) * 2000 + (event_id * 37) % 1500 + 1000 * (1 + event_id % 30) AS te_ms, 'SPEAKER_' || lpad(CAST(user_id % 6 AS VARCHAR), 2, '0') AS speaker
  FROM events WHERE event_type NOT IN ('click', 'view'))"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as chunks of a speaker with an emotion: clip_id, speaker, emotion, ms."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("clip_id"), F.concat(F.lit("S"), (F.col("user_id") % 6).cast("string")).alias("speaker"), F.element_at(F.array(*map(F.lit, EMOTIONS)), (e % 7 + 1).cast("int")).alias("emotion"), (500 + (e * 7919) % 20000).alias("ms"))


TAGGED_SQL = """tagged AS (SELECT event_id AS clip_id, 'S' || (user_id % 6) AS speaker,
  (['neutral','neutral','neutral','angry','happy','sad','unknown'])[event_id % 7 + 1] AS emotion, 500 + (event_id * 7919) % 20000 AS ms FROM events)"""


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthesis statistics: job, n, ts, input_chars, audio_ms, synth_ms, retries_used, hook_count."""
    e = F.col("event_id")
    audio = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(
        (e % 25).alias("job"), F.floor(e / 25).alias("n"), F.col("ts").cast("timestamp").alias("ts"), (50 + e % 250).alias("input_chars"), F.when(e % 97 == 0, 0).otherwise(audio).alias("audio_ms"), (F.floor(audio * (50 + e % 100) / 100)).alias("synth_ms"), (e % 3).alias("retries_used"), F.floor(e / 700).alias("hook_count")
    )


STATS_SQL = """stats AS (SELECT event_id % 25 AS job, event_id // 25 AS n, ts, 50 + event_id % 250 AS input_chars,
  CASE WHEN event_id % 97 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS audio_ms,
  CAST(round(value * 100) AS BIGINT) * (50 + event_id % 100) // 100 AS synth_ms, event_id % 3 AS retries_used, event_id // 700 AS hook_count FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal frames by clip: clip_id, frame_idx, amp (an int16 sample)."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select((e % 40).alias("clip_id"), F.floor(e / 40).alias("frame_idx"), F.least(F.greatest(F.floor(F.col("value") * 400 - 20000), F.lit(-32768)), F.lit(32767)).alias("amp"))


FRAMES_SQL = """frame AS (SELECT event_id % 40 AS clip_id, event_id // 40 AS frame_idx,
  least(greatest(CAST(floor(value * 400 - 20000) AS BIGINT), -32768), 32767) AS amp FROM events)"""


#: Samples a second of ``speech``.
SPEECH_RATE = 100


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of clips with silent stretches, 100 a second: clip_id, i, x in [-1, 1]."""
    i, q = F.col("frame_idx"), (F.col("frame_idx") + F.col("clip_id") * 7) % 90
    quiet = (q < 22 + F.col("clip_id") % 30) | (F.col("clip_id") == 39)
    return frames(spark, sf_dir).select("clip_id", i.alias("i"), (F.when(quiet, F.floor(F.col("amp") / 1024)).otherwise(F.col("amp")) / 32768.0).alias("x"))


SPEECH_SQL = f"""{FRAMES_SQL}, speech AS (SELECT clip_id, frame_idx AS i, CASE WHEN (frame_idx + clip_id * 7) % 90 < 22 + clip_id % 30 OR clip_id = 39 THEN floor(amp / 1024) ELSE amp END / 32768.0::DOUBLE AS x FROM frame)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines of jobs in eight shapes: job_id, line_no, line."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    s = lambda c: c.cast("string")
    k = (o + n) % 8
    qty = F.col("l_quantity").cast("int")
    chunk = F.concat(F.lit("[chapter "), s(n), F.lit("/8] chunk "), s(qty), F.lit("/60 ("), s(qty + n * 60), F.lit("/480 total) - "), s(o % 3), F.lit("h"), s(o % 60), F.lit("m elapsed, ~"), s(o % 50), F.lit("m"), s(qty), F.lit("s remaining, RTF 0."), s(10 + o % 90), F.lit("x"))
    line = (
        F.when(k < 2, chunk)
        .when(k == 2, F.concat(F.lit("[setup] total chunks to synthesize: "), s(o % 900)))
        .when(k == 3, F.concat(F.lit("[setup] cached chunks found: "), s(qty), F.lit("/"), s(o % 900)))
        .when(k == 4, F.concat(F.lit("[chapter "), s(n), F.lit("/8] idx="), s(o % 7), F.lit(" title=Part "), s(o % 9), F.lit(" chunks="), s(qty)))
        .when(k == 5, F.concat(F.lit("[chapter "), s(n), F.lit("/8] wrote out/"), s(o), F.lit(".mp3 ("), s(qty), F.lit(".5s)")))
        .when(k == 6, F.concat(F.lit("[done] "), s(qty), F.lit("/60 chunks")))
        .otherwise(F.when(n % 3 == 0, "[error] device lost").when(n % 3 == 1, F.concat(F.lit("WARNING: Detected "), s(2 + n), F.lit("x repetition of token "), s(o % 7000), F.lit(" at position "), s(qty))).otherwise("Forcing EOS generation to prevent loop."))
    )
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return lines.select((o % 50).alias("job_id"), ((o * 10 + n) * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") % 10000).alias("line_no"), line.alias("line"))


LOGS_SQL = """logs AS (SELECT l_orderkey % 50 AS job_id, (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 AS line_no, CASE (l_orderkey + l_linenumber) % 8
  WHEN 0 THEN format('[chapter {}/8] chunk {}/60 ({}/480 total) - {}h{}m elapsed, ~{}m{}s remaining, RTF 0.{}x', l_linenumber, q, q + l_linenumber * 60, l_orderkey % 3, l_orderkey % 60, l_orderkey % 50, q, 10 + l_orderkey % 90)
  WHEN 1 THEN format('[chapter {}/8] chunk {}/60 ({}/480 total) - {}h{}m elapsed, ~{}m{}s remaining, RTF 0.{}x', l_linenumber, q, q + l_linenumber * 60, l_orderkey % 3, l_orderkey % 60, l_orderkey % 50, q, 10 + l_orderkey % 90)
  WHEN 2 THEN format('[setup] total chunks to synthesize: {}', l_orderkey % 900)
  WHEN 3 THEN format('[setup] cached chunks found: {}/{}', q, l_orderkey % 900)
  WHEN 4 THEN format('[chapter {}/8] idx={} title=Part {} chunks={}', l_linenumber, l_orderkey % 7, l_orderkey % 9, q)
  WHEN 5 THEN format('[chapter {}/8] wrote out/{}.mp3 ({}.5s)', l_linenumber, l_orderkey, q)
  WHEN 6 THEN format('[done] {}/60 chunks', q)
  ELSE CASE l_linenumber % 3 WHEN 0 THEN '[error] device lost' WHEN 1 THEN format('WARNING: Detected {}x repetition of token {} at position {}', 2 + l_linenumber, l_orderkey % 7000, q)
    ELSE 'Forcing EOS generation to prevent loop.' END END AS line
  FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem))"""
