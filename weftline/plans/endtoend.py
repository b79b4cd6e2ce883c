"""Queries that run from sources to written datasets, with stand-ins for the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.sql import Backends
from weftline.operators import analysis as A
from weftline.operators import text as X
from weftline.plans.logs import _folder
from weftline.plans.registry import query
from weftline.plans.speech import _TIER
from weftline.session import spread, table
from weftline.sources import derived as D
from weftline.sources import records as R


def _backends(spark, d) -> Backends:
    """Models that know the derived segments and turns of the recordings that they are asked for."""
    b = Backends()
    b.add("segments", lambda recordings: recordings.join(D.segments(spark, d), "source_id"), ("en", "fi"))
    b.add("turns", lambda recordings: recordings.join(D.turns(spark, d), "source_id"))
    return b


_SQL = f"""WITH {D.SEGMENTS_SQL}, {D.TURNS_SQL}, o AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS nw FROM turn WHERE source_id % 2 = 0 WINDOW w AS (PARTITION BY source_id ORDER BY ts_ms, turn_idx)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY source_id ORDER BY ts_ms, turn_idx) AS run FROM o),
c AS (SELECT *, max(te_ms) OVER (PARTITION BY source_id, run ORDER BY ts_ms, turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
e AS (SELECT *, sum(CASE WHEN reach IS NULL OR ts_ms - reach >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, run ORDER BY ts_ms, turn_idx) AS island FROM c),
m AS (SELECT source_id, speaker, min(ts_ms) AS a, max(te_ms) AS z FROM e GROUP BY source_id, run, island, speaker),
pairs AS (SELECT seg.*, speaker, least(e_ms, z) - greatest(s_ms, a) AS ov, row_number() OVER (PARTITION BY seg.source_id, seg_idx ORDER BY least(e_ms, z) - greatest(s_ms, a) DESC, a, speaker) AS r FROM seg JOIN m ON seg.source_id = m.source_id AND s_ms < z AND a < e_ms),
good AS (SELECT * FROM pairs WHERE r = 1 AND e_ms - s_ms BETWEEN 1000 AND 30000 AND confidence >= 0.3 AND trim(text) <> ''), s AS (SELECT speaker, sum(e_ms - s_ms)::BIGINT AS ms, count(*) AS n FROM good GROUP BY ALL)
SELECT speaker, ms / 1000 AS total_seconds, n AS chunk_count, {_TIER.format('(ms / 1000)')} AS quality_tier, (SELECT count(*) FROM good) AS transcripts FROM s"""


@query("analyze_recordings", _SQL)
def analyze_recordings(spark, d):
    """Every other recording through transcription, diarization, assignment, filter and summary, written as a dataset and read back."""
    recordings = table(spark, d, "events").select((F.col("event_id") % 20).alias("source_id")).distinct().where("source_id % 2 = 0")
    b = _backends(spark, d)
    paths = A.write_analysis(A.analyze(recordings, transcribe=b.get("segments"), diarize=b.get("turns")), _folder(spark))
    lines = R.read_transcripts(spark, paths["transcripts"]).count()
    return R.read_summaries(spark, paths["speakers"]).select("speaker", "total_seconds", "chunk_count", "quality_tier", F.lit(lines).cast("long").alias("transcripts"))


@query("plan_books")
def plan_books(spark, d):
    """Documents as books, from lines to spoken chunks with their length."""
    chapters = X.split_chapters(X.lines_with_headings(spread(table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text")), every=200))
    return A.book_plan(spread(chapters), "en")
