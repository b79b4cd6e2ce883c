"""Queries of log parsing and streams; a stream's result is held against its batch in SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.session import table
from weftline.sources import derived as D
from weftline.streaming import events as V

_LG = f"WITH {D.LOGS_SQL} "


def _folder(spark) -> str:
    """A new folder below the shared one, or a temporary one where the session names none."""
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/weftline/{uuid.uuid4().hex}" if root else tempfile.mkdtemp(prefix="weftline-")


_PARSED = """SELECT job_id, line_no, CASE WHEN line LIKE '[chapter %] chunk %' THEN 'chunk' WHEN line LIKE '[setup] total%' THEN 'setup_total' WHEN line LIKE '[setup] cached%' THEN 'setup_cached' WHEN line LIKE '%title=%' THEN 'chapter_start'
  WHEN line LIKE '% wrote %' THEN 'chapter_done' WHEN line LIKE '[done]%' THEN 'done' WHEN line LIKE '[error]%' THEN 'error' ELSE 'log' END AS kind,
  CASE WHEN line LIKE '[chapter %' THEN regexp_extract(line, '([0-9]+)/8', 1)::INTEGER END AS chapter_idx,
  CASE WHEN line LIKE '%/480 total%' THEN regexp_extract(line, '\\(([0-9]+)/480', 1)::INTEGER WHEN line LIKE '[setup] cached%' THEN regexp_extract(line, 'found: ([0-9]+)', 1)::INTEGER WHEN line LIKE '[done]%' THEN regexp_extract(line, '([0-9]+)/', 1)::INTEGER END AS total_done,
  CASE WHEN line LIKE '%/480 total%' THEN 480 WHEN line LIKE '[setup]%' THEN regexp_extract(line, '([0-9]+)$', 1)::INTEGER WHEN line LIKE '[done]%' THEN 60 END AS total_chunks,
  CASE WHEN line LIKE '%/480 total%' THEN regexp_extract(line, '- ([0-9]+)h', 1)::INTEGER * 3600 + regexp_extract(line, 'h([0-9]+)m elapsed', 1)::INTEGER * 60 END::BIGINT AS elapsed_s,
  CASE WHEN line LIKE '%/480 total%' THEN regexp_extract(line, 'RTF ([0-9.]+)x', 1)::DOUBLE END AS rtf, CASE WHEN line LIKE '% wrote %' THEN regexp_extract(line, 'wrote ([^ ]+)', 1) END AS output_path FROM logs"""
_FIELDS = ("job_id", "line_no", "kind", "chapter_idx", "total_done", "total_chunks", "elapsed_s", "rtf", "output_path")


@query("parse_progress", _LG + _PARSED)
def parse_progress(spark, d):
    return V.events(D.log_lines(spark, d)).select(*_FIELDS)


@query("parse_progress_stream", _LG + _PARSED)
def parse_progress_stream(spark, d):
    """The same over a stream of files, written with exactly-once files and read back."""
    root = _folder(spark)
    D.log_lines(spark, d).write.parquet(f"{root}/in")
    lines = spark.readStream.schema("job_id long, line_no long, line string").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    V.drain(V.events(lines).select(*_FIELDS), f"{root}/q")
    return spark.read.parquet(f"{root}/q/out")


@query("rewrite_noise", _LG + "SELECT job_id, line_no, CASE WHEN line LIKE 'WARNING: Detected%' THEN '[info] alignment fix applied on token ' || regexp_extract(line, 'token ([0-9]+)', 1) || ' at position ' || regexp_extract(line, 'position ([0-9]+)', 1) ELSE line END AS line FROM logs WHERE line NOT LIKE 'Forcing EOS%'")
def rewrite_noise(spark, d):
    return V.rewrite_noise(D.log_lines(spark, d))


@query("parse_stage_stamp", "SELECT event_id, stage, elapsed_s FROM (SELECT event_id, (['asr','diarize','bucket','write','other'])[event_id % 5 + 1] AS stage, (event_id % 1000) / 10.0::DOUBLE AS elapsed_s FROM events) WHERE stage <> 'other'")
def parse_stage_stamp(spark, d):
    e = F.col("event_id")
    stage = F.element_at(F.array(*map(F.lit, ("asr", "Diarize", "bucket", "write", "other"))), (e % 5 + 1).cast("int"))
    line = F.concat(F.lit("x [voice_pack_analyze] "), stage, F.lit(": "), ((e % 1000) / 10.0).cast("string"), F.lit("s"))
    return V.stage_stamps(table(spark, d, "events").select("event_id", line.alias("line"))).select("event_id", "stage", "elapsed_s")


_STATE = _LG + f""", p AS ({_PARSED}) SELECT job_id, arg_max(kind, line_no) AS kind, round(arg_max(total_done * 100.0 / total_chunks, line_no) FILTER (kind = 'chunk'), 4)::DOUBLE AS bar, max(CASE WHEN kind IN ('done', 'error', 'full_done') THEN 1 ELSE 0 END) = 1 AS ended FROM p GROUP BY job_id"""


@query("progress_state", _STATE)
def progress_state(spark, d):
    return V.progress_state(V.events(D.log_lines(spark, d)))


@query("progress_state_stream", _STATE)
def progress_state_stream(spark, d):
    """The state kept by a stream in update mode; of a job's rows the newest micro-batch counts."""
    root = _folder(spark)
    D.log_lines(spark, d).write.parquet(f"{root}/in")
    lines = spark.readStream.schema("job_id long, line_no long, line string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    V.drain_updates(V.progress_state(V.events(lines)), root, "job_id")
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("kind", "bar", "ended"), "batch").alias("l")).select("job_id", "l.*")


_WIN = f"WITH {D.STATS_SQL} SELECT date_trunc('day', ts) AS day, count(*) AS chunks, sum(audio_ms)::BIGINT AS audio_ms, sum(synth_ms)::BIGINT AS synth_ms FROM stats GROUP BY 1"


@query("chunk_stats_stream", _WIN)
def chunk_stats_stream(spark, d):
    """Watermarked tumbling windows over a stream of files. A last row, far ahead, moves the watermark past all windows before it, so that they close and are
    written; its own never does. Files are read in one micro-batch, so that no row is late."""
    root = _folder(spark)
    stats = D.chunk_stats(spark, d)
    far = stats.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    stats.unionByName(far).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    lines = V.windowed_stats(spark.readStream.schema(schema).parquet(f"{root}/in"))
    V.drain(lines, f"{root}/q")
    closed = spark.read.schema(lines.schema).parquet(f"{root}/q/out")
    return closed.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "chunks", "audio_ms", "synth_ms")


@query("spoken_severity", _LG + "SELECT job_id, line_no, CASE WHEN line LIKE '[error]%' THEN 'error' WHEN line LIKE '%WARNING%' THEN 'warning' WHEN line LIKE '[done]%' THEN 'success' ELSE 'info' END AS severity FROM logs")
def spoken_severity(spark, d):
    return D.log_lines(spark, d).select("job_id", "line_no", V.severity(F.col("line")).alias("severity"))


@query("tail_lines", _LG + "SELECT job_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC) AS r FROM logs) WHERE r <= 20")
def tail_lines(spark, d):
    from pyspark.sql import Window as W

    r = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("line_no")))
    return D.log_lines(spark, d).withColumn("r", r).where("r <= 20").drop("r")


@query("cooperative_cancel", _LG + "SELECT count(*) AS lines, count(DISTINCT line_no) AS different, true AS stopped_early FROM logs")
def cooperative_cancel(spark, d):
    """A stream that is told to stop after two of its micro-batches ends there, and when it is started again loses and repeats nothing."""
    root = _folder(spark)
    D.log_lines(spark, d).repartition(6, "line_no").write.parquet(f"{root}/in")
    lines = spark.readStream.schema("job_id long, line_no long, line string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    done: list[int] = []
    ended = V.run_batches(lines, f"{root}/q", lambda: len(done) >= 2, done.append)
    first = spark.read.parquet(f"{root}/q/out").count()
    V.run_batches(lines, f"{root}/q")
    out = spark.read.parquet(f"{root}/q/out")
    total = out.count()
    return out.agg(F.count("*").alias("lines"), F.count_distinct("line_no").alias("different")).withColumn("stopped_early", F.lit(not ended and 0 < first < total))
