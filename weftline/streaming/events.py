"""Log lines as typed events: the same expressions serve batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import parse_hms

# fixed values: line formats, in the order in which they are tried
CHUNK = r"^\[chapter (\d+)/(\d+)\] chunk (\d+)/(\d+) \((\d+)/(\d+) total\) - (\S+) elapsed, ~(\S+) remaining, RTF ([\d.]+)x"
SETUP_TOTAL = r"^\[setup\] total chunks to synthesize: (\d+)"
SETUP_CACHED = r"^\[setup\] cached chunks found: (\d+)/(\d+)"
CHAPTER_START = r"^\[chapter (\d+)/(\d+)\] idx=(\d+) title=(.+?) chunks=(\d+)"
CHAPTER_DONE = r"^\[chapter (\d+)/(\d+)\] wrote (\S+\.mp3) \(([\d.]+)s\)"
FULL_DONE = r"^\[full\] wrote (\S+\.mp3) \(([\d.]+)s\)"
DONE = r"^\[done\] (\d+)/(\d+) chunks"
KINDS = [("chunk", CHUNK), ("setup_total", SETUP_TOTAL), ("setup_cached", SETUP_CACHED), ("chapter_start", CHAPTER_START), ("chapter_done", CHAPTER_DONE), ("full_done", FULL_DONE), ("done", DONE), ("error", r"^\[error\]"), ("signal", r"^\[signal\]")]
TERMINAL = ("full_done", "done", "error")
REPETITION = r"(?i)WARNING[:\s].*?Detected\s+\d+x\s+repetition of token\s+(\d+)(?:\s+at position\s+(\d+))?"
FORCED_END = r"(?i)(?:Forcing EOS generation|forcing EOS token)"
STAMP = r"\[voice_pack_analyze\]\s+([a-zA-Z_]+):\s+([0-9]+(?:\.[0-9]+)?)s"
STAGES = ("asr", "diarize", "bucket", "write")
SUCCESS = r"(?i)valmis|✔|^\[done\]"


#: How lines of each kind begin: most lines are told apart without a pattern.
BEGINS = {"chunk": "[chapter ", "setup_total": "[setup] total", "setup_cached": "[setup] cached", "chapter_start": "[chapter ", "chapter_done": "[chapter ", "full_done": "[full]", "done": "[done]", "error": "[error]", "signal": "[signal]"}
#: What lines of a kind with a common beginning hold besides.
HOLDS = {"chunk": "] chunk ", "chapter_start": "] idx=", "chapter_done": "] wrote "}


def kind_of(line: Column) -> Column:
    out = F.lit("log")
    for name, pattern in reversed(KINDS):
        likely = line.startswith(BEGINS[name])
        if name in HOLDS:
            likely = likely & line.contains(HOLDS[name])
        out = F.when(likely & line.rlike(pattern) if name not in ("error", "signal") else likely, name).otherwise(out)
    return out


#: Groups of each kind's pattern that are kept: kind -> field -> group.
FIELDS = {
    "chunk": {"chapter_idx": 1, "chapter_total": 2, "chunk_idx": 3, "chunk_total": 4, "total_done": 5, "total_chunks": 6, "elapsed": 7, "eta": 8, "rtf": 9},
    "setup_total": {"total_chunks": 1}, "setup_cached": {"total_done": 1, "total_chunks": 2}, "chapter_start": {"chapter_idx": 1, "chapter_total": 2, "chunk_total": 5},
    "chapter_done": {"chapter_idx": 1, "chapter_total": 2, "output_path": 3}, "full_done": {"output_path": 1}, "done": {"total_done": 1, "total_chunks": 2},
}
_SIGN = "\x01"


def events(lines: DataFrame) -> DataFrame:
    """``line`` as kind and fields; fields that a kind lacks are null. Columns other than ``line`` pass through.

    A line's fields come from one replacement by its kind's pattern, which leaves the groups between control signs."""
    keep = [c for c in lines.columns if c != "line"]
    raw, kind = F.col("raw_line"), F.col("kind")
    t = lines.select(*keep, F.regexp_replace("line", r"[\r\n]+$", "").alias("raw_line"))
    t = t.withColumn("kind", kind_of(raw))
    patterns, split = dict(KINDS), F.lit(None).cast("array<string>")
    for k, fields in FIELDS.items():
        found = F.split(F.regexp_replace(raw, f"(?s){patterns[k]}.*$", _SIGN.join(f"${g}" for g in fields.values())), _SIGN)
        split = F.when(kind == k, found).otherwise(split)
    t = t.withColumn("found", split)
    where: dict[str, list[tuple[str, int]]] = {}
    for k, fields in FIELDS.items():
        for i, name in enumerate(fields):
            where.setdefault(name, []).append((k, i))

    def field(name: str, type_: str) -> Column:
        place = F.lit(None).cast("int")
        for k, i in where[name]:
            place = F.when(kind == k, i).otherwise(place)
        return F.get("found", place).try_cast(type_)

    hms = lambda name: F.when(kind == "chunk", parse_hms(field(name, "string")))
    numbers = [field(n, "int").alias(n) for n in ("chapter_idx", "chapter_total", "chunk_idx", "chunk_total", "total_done", "total_chunks")]
    return t.select(*keep, "kind", *numbers, hms("elapsed").alias("elapsed_s"), hms("eta").alias("eta_s"), field("rtf", "double").alias("rtf"), field("output_path", "string").alias("output_path"), "raw_line")


def rewrite_noise(lines: DataFrame) -> DataFrame:
    """Alarms about repetition become notes; what follows them goes."""
    line = F.col("line")
    token, at = F.regexp_extract(line, REPETITION, 1), F.regexp_extract(line, REPETITION, 2)
    note = F.concat(F.lit("[info] alignment fix applied on token "), token, F.when(at != "", F.concat(F.lit(" at position "), at)).otherwise(""))
    return lines.where(line.rlike(REPETITION) | ~line.rlike(FORCED_END)).withColumn("line", F.when(line.rlike(REPETITION), note).otherwise(line))


def stage_stamps(lines: DataFrame) -> DataFrame:
    """Timing stamps of known stages: stage, elapsed_s."""
    stage = F.lower(F.regexp_extract("line", STAMP, 1))
    return lines.where(stage.isin(*STAGES)).withColumn("stage", stage).withColumn("elapsed_s", F.regexp_extract("line", STAMP, 2).cast("double"))


def severity(line: Column) -> Column:
    up = F.upper(line)
    return F.when(line.startswith("[error]") | up.contains("ERROR:") | up.contains("TRACEBACK") | line.contains("✘"), "error").when(up.contains("WARNING") | up.contains("WARN:"), "warning").when(line.rlike(SUCCESS), "success").otherwise("info")


def progress_state(parsed: DataFrame, job: str = "job_id", order: str = "line_no") -> DataFrame:
    """The latest event of each job, its bar and whether it has ended. An aggregation, so it runs on streams in update mode."""
    last = F.max_by(F.struct("kind", "total_done", "total_chunks", "eta_s"), order)
    ended = F.max(F.col("kind").isin(*TERMINAL).cast("int"))
    g = parsed.groupBy(job).agg(last.alias("l"), F.max(order).alias(order), ended.alias("ended"), F.max_by(F.struct("total_done", "total_chunks"), F.when(F.col("kind") == "chunk", F.col(order))).alias("c"))
    bar = F.round(F.try_divide(F.col("c.total_done") * 100.0, F.col("c.total_chunks")), 4)
    return g.select(job, F.col("l.kind").alias("kind"), bar.alias("bar"), (F.col("ended") == 1).alias("ended"))


def windowed_stats(stats: DataFrame, *, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Sums of synthesis statistics by tumbling event-time windows; on a stream, windows close ``late`` behind the newest row."""
    source = stats.withWatermark("ts", late) if stats.isStreaming else stats
    return source.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("chunks"), F.sum("audio_ms").alias("audio_ms"), F.sum("synth_ms").alias("synth_ms"))


def drain(stream: DataFrame, folder: str, *, mode: str = "append") -> None:
    """Run a stream over what is there, with its checkpoint and its Parquet output below ``folder``, and stop: a second run resumes."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def drain_updates(stream: DataFrame, folder: str, key: str) -> None:
    """Run an updating aggregation over what is there; each micro-batch writes its changed rows under its number, so a replayed
    batch overwrites its own rows and the newest number of a key counts."""
    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/b={batch}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


class Stopped(Exception):
    """Raised between micro-batches once a stop was asked for."""


def run_batches(stream: DataFrame, folder: str, stop: Callable[[], bool] = lambda: False, seen: Callable[[int], object] = lambda batch: None) -> bool:
    """Run a stream over what is there, each micro-batch into a folder of its number (a replayed one replaces its own rows), and ask ``stop`` before each. A batch that is
    stopped isn't committed, so the next run begins with it. Returns whether the stream came to its end; ``seen`` gets the number of each batch that is done."""
    def put(rows: DataFrame, batch: int) -> None:
        if stop():
            raise Stopped
        rows.write.mode("overwrite").parquet(f"{folder}/out/b={batch}")
        seen(batch)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
        return True
    except StreamingQueryException as e:
        if "Stopped" not in str(e):
            raise
        return False
    finally:
        q.stop()
