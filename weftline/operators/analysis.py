"""From recordings to a speaker dataset, and from books to a chunk plan, with the models given by the caller."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import speech as P
from weftline.operators import text as X

#: A backend takes the recordings (source_id and whatever it needs) and gives rows of its own.
Backend = Callable[[DataFrame], DataFrame]
SEGMENT = ("source_id", "seg_idx", "s_ms", "e_ms", "text", "confidence")
TURN = ("source_id", "turn_idx", "ts_ms", "te_ms", "speaker")


@dataclass(frozen=True)
class Analysis:
    """Segments with their speaker, those of them that are good, and the speakers' sums over these."""

    chunks: DataFrame
    good: DataFrame
    speakers: DataFrame


def _asked(backend: Backend, recordings: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    rows = backend(recordings)
    lacks = [c for c in columns if c not in rows.columns]
    if lacks:
        raise ValueError(f"the {what} backend gives no {', '.join(lacks)}")
    return rows.select(*columns)


def analyze(recordings: DataFrame, *, transcribe: Backend, diarize: Backend) -> Analysis:
    """Segments of ``transcribe`` meet the turns of ``diarize``; turns that continue each other are merged before. Segments that no turn
    overlaps have no speaker and take no part."""
    segments = _asked(transcribe, recordings, SEGMENT, "transcribe")
    turns = P.merge_turns(_asked(diarize, recordings, TURN, "diarize"))
    turns = turns.withColumn("turn_idx", F.row_number().over(W.partitionBy("source_id").orderBy("ts_ms", "speaker"))).select(*TURN)
    chunks = P.assign_speakers(segments, turns)
    good = P.quality_filter(chunks)
    return Analysis(chunks, good, P.summarize_speakers(good, "speaker"))


def write_analysis(a: Analysis, folder: str) -> dict[str, str]:
    """The dataset's files: transcripts as JSON lines, speakers as YAML, the report's table as Markdown. Returns their paths."""
    from weftline.sources import records as R

    paths = {"transcripts": f"{folder}/transcripts", "speakers": f"{folder}/speakers.yaml", "report": f"{folder}/report.md"}
    rows = a.good.select((F.col("s_ms") / 1000).alias("start"), (F.col("e_ms") / 1000).alias("end"), "text", "speaker", "confidence", F.lit(None).cast("string").alias("character"))
    R.write_transcripts(rows, paths["transcripts"])
    R.write_summaries(a.speakers, paths["speakers"])
    table = [r["row"] for r in R.report_rows(a.speakers).orderBy("place").collect()]  # a row for each speaker
    R.write_whole(paths["report"], "\n".join(["| speaker | minutes | chunks | mean s | tier |", "|---|---|---|---|---|", *table, ""]))
    return paths


def book_plan(chapters: DataFrame, lang: str, *, most_chars: int = 300, chunks_per_chapter: int = 0, speak: Callable | None = None) -> DataFrame:
    """The synthesis plan of (doc_id, idx, title, content): prose chapters from 1 on, their spoken text in chunks, and what each will last: doc_id, chapter,
    chunk_idx, chunk, audio_s. ``speak`` replaces the language's normalizer."""
    from weftline.operators.normalize import spoken

    say = speak or (lambda t: spoken(t, lang))
    prose = X.prose_chapters(chapters.withColumnRenamed("content", "text"), "doc_id", "idx")
    chunks = X.capped(X.chunks(say(S.sentence_start(F.col("text"))), most_chars), chunks_per_chapter)
    out = prose.select("doc_id", F.col("pos").alias("chapter"), F.posexplode(chunks).alias("chunk_idx", "chunk"))
    return out.withColumn("audio_s", S.estimate_audio(F.length("chunk"), F.lit(lang)))
