"""Queries of projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.plans import cleaning_sql as Q
from weftline.plans.registry import query
from weftline.session import spread, table
from weftline.sources import derived as D

_SEG = f"WITH {D.SEGMENTS_SQL} "


@query("filter_quality", _SEG + """SELECT source_id, seg_idx, s_ms, e_ms, confidence FROM seg
WHERE e_ms - s_ms BETWEEN 1000 AND 30000 AND confidence >= 0.3 AND trim(text) <> ''""")
def filter_quality(spark, d):
    from weftline.operators.speech import quality_filter

    return quality_filter(D.segments(spark, d)).select("source_id", "seg_idx", "s_ms", "e_ms", "confidence")


@query("chapter_is_prose", r"""SELECT doc_id, length(t) >= 3000 AND (length(t) - length(replace(t, '.', ''))) / length(t) <= 0.05
  AND len(w) > 0 AND len([x for x in w if length(x) = 1 and regexp_full_match(x, '\p{L}')]) / len(w) <= 0.2 AS prose
FROM (SELECT doc_id, t, [x for x in regexp_split_to_array(left(t, 500), '\s+') if x <> ''] AS w FROM
  (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents))""")
def chapter_is_prose(spark, d):
    return table(spark, d, "documents").select("doc_id", S.is_prose(F.col("text")).alias("prose"))


@query("select_chapters", r"""WITH c AS (SELECT doc_id, source, length(t) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
  length(t) >= 3000 AND (length(t) - length(replace(t, '.', ''))) / length(t) <= 0.05
  AND len(w) > 0 AND len([x for x in w if length(x) = 1 and regexp_full_match(x, '\p{L}')]) / len(w) <= 0.2 AS prose
  FROM (SELECT doc_id, source, t, [x for x in regexp_split_to_array(left(t, 500), '\s+') if x <> ''] AS w FROM
  (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)))
SELECT source, idx, doc_id, row_number() OVER (PARTITION BY source ORDER BY idx) AS pos FROM c WHERE prose AND idx % 3 <> 1""")
def select_chapters(spark, d):
    from weftline.operators.text import number_within, prose_chapters

    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    chapters = number_within(docs, "source", "doc_id").withColumnRenamed("n", "idx")
    return prose_chapters(chapters.where(F.col("idx") % 3 != 1), "source", "idx").select("source", "idx", "doc_id", "pos")


@query("text_penalties", r"""SELECT doc_id, array_to_string([x for x in [CASE WHEN regexp_matches(t, '[0-9]') THEN 'digits' END,
  CASE WHEN regexp_matches(t, '[A-ZÄÖÅ]{3,}') THEN 'acronym' END,
  CASE WHEN n < 6 THEN 'too_few_words' WHEN n > 80 THEN 'too_many_words' END] if x is not null], ',') AS penalties
FROM (SELECT doc_id, text AS t, len([x for x in regexp_split_to_array(text, '\s+') if x <> '']) AS n FROM documents)""")
def text_penalties(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(S.text_penalties(F.col("text")), ",").alias("penalties"))


@query("valid_preset_name", "SELECT p_partkey, name, regexp_matches(name, '^[a-z_][a-z0-9_]*$') AS ok FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(replace(p_name, ' ', '_')) ELSE p_name END AS name FROM part)")
def valid_preset_name(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("ok", F.col("name").rlike("^[a-z_][a-z0-9_]*$"))


@query("classify_quality_tier", "SELECT c_custkey, CASE WHEN s >= 1800 THEN 'full_lora' WHEN s >= 600 THEN 'reduced_lora' WHEN s >= 60 THEN 'few_shot' ELSE 'skip' END AS tier FROM (SELECT c_custkey, c_custkey % 2400 AS s FROM customer)")
def classify_quality_tier(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.quality_tier(F.col("c_custkey") % 2400).alias("tier"))


@query("apply_tier_policy", """SELECT c_custkey, tier, CASE tier WHEN 'full_lora' THEN 32 WHEN 'reduced_lora' THEN 8 END AS lora_rank,
  CASE tier WHEN 'full_lora' THEN 3 WHEN 'reduced_lora' THEN 2 END AS epochs, tier = 'reduced_lora' AS reduced_mode,
  CASE WHEN tier IN ('few_shot', 'skip') THEN 'Tier ' || tier || ' does not support training' END AS reason
FROM (SELECT c_custkey, CASE WHEN s >= 1800 THEN 'full_lora' WHEN s >= 600 THEN 'reduced_lora' WHEN s >= 60 THEN 'few_shot' ELSE 'skip' END AS tier FROM (SELECT c_custkey, c_custkey % 2400 AS s FROM customer))""")
def apply_tier_policy(spark, d):
    t = F.col("tier")
    full, reduced = t == "full_lora", t == "reduced_lora"
    return table(spark, d, "customer").select("c_custkey", S.quality_tier(F.col("c_custkey") % 2400).alias("tier")).select(
        "c_custkey", "tier", F.when(full, 32).when(reduced, 8).alias("lora_rank"), F.when(full, 3).when(reduced, 2).alias("epochs"), reduced.alias("reduced_mode"),
        F.when(~full & ~reduced, F.concat(F.lit("Tier "), t, F.lit(" does not support training"))).alias("reason")
    )


@query("asr_confidence", "SELECT event_id, CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE greatest(0.0, least(1.0, 1 + p)) END AS confidence FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN -((event_id % 150) / 100.0::DOUBLE) END AS p, CASE WHEN event_id % 11 = 0 THEN '  ' ELSE event_type END AS text FROM events) WHERE trim(text) <> ''")
def asr_confidence(spark, d):
    e = F.col("event_id")
    text = F.when(e % 11 == 0, "  ").otherwise(F.col("event_type"))
    return table(spark, d, "events").where(F.trim(text) != "").select("event_id", S.asr_confidence(F.when(e % 9 != 0, -(e % 150) / 100.0)).alias("confidence"))


@query("promote_tagged", _SEG + "SELECT source_id, seg_idx, text, 'neutral' AS emotion, 0.0::DOUBLE AS emotion_confidence FROM seg")
def promote_tagged(spark, d):
    return D.segments(spark, d).select("source_id", "seg_idx", "text", F.lit("neutral").alias("emotion"), F.lit(0.0).alias("emotion_confidence"))


@query("emotion_label_map", "SELECT event_id, CASE WHEN ms < 100 THEN 'unknown' ELSE coalesce(map {'ang':'angry','hap':'happy','sad':'sad','neu':'neutral'}[left(lab, 3)], 'unknown') END AS emotion, CASE WHEN ms < 100 OR lab NOT IN ('ang','hap','sad','neu') THEN 0.0 ELSE c END::DOUBLE AS confidence FROM (SELECT event_id, (['ang','hap','sad','neu','xxx'])[event_id % 5 + 1] AS lab, event_id % 700 AS ms, (event_id % 10) / 10.0::DOUBLE AS c FROM events)")
def emotion_label_map(spark, d):
    e = F.col("event_id")
    lab = F.element_at(F.array(*map(F.lit, ("ang", "hap", "sad", "neu", "xxx"))), (e % 5 + 1).cast("int"))
    name = F.when(e % 700 < 100, "unknown").otherwise(S.lookup(S.EMOTION_NAMES, lab, "unknown"))
    return table(spark, d, "events").select("event_id", name.alias("emotion"), F.when(name == "unknown", 0.0).otherwise((e % 10) / 10.0).alias("confidence"))


_ENGINES = ("edge", "piper", "chatterbox_fi", "voxcpm2", "other")
_ENGINE_SQL = "(['edge','piper','chatterbox_fi','voxcpm2','other'])[doc_id % 5 + 1]"


def _engine(key):
    return F.element_at(F.array(*map(F.lit, _ENGINES)), (key % 5 + 1).cast("int"))


@query("estimate_duration", "SELECT doc_id, round(length(text) / CASE lang WHEN 'en' THEN 22.5 ELSE 20.0 END, 6)::DOUBLE AS seconds FROM documents")
def estimate_duration(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(S.estimate_audio(F.length("text"), F.col("lang")), 6).alias("seconds"))


_WALL = f"""SELECT doc_id, engine, chars, audio, audio / CASE engine WHEN 'edge' THEN 5.0 WHEN 'piper' THEN 6.0 WHEN 'chatterbox_fi' THEN 0.85 WHEN 'voxcpm2' THEN 1.0 ELSE 2.0 END
  * CASE WHEN engine IN ('chatterbox_fi', 'voxcpm2') AND doc_id % 2 = 0 THEN 20 ELSE 1 END AS wall
  FROM (SELECT doc_id, {_ENGINE_SQL} AS engine, length(text) AS chars, length(text) / CASE lang WHEN 'en' THEN 22.5::DOUBLE ELSE 20.0 END AS audio FROM documents)"""


def _estimates(spark, d):
    key, text = F.col("doc_id"), F.col("text")
    audio = S.estimate_audio(F.length(text), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", _engine(key).alias("engine"), F.length(text).cast("long").alias("chars"), audio.alias("audio"), S.estimate_wall(audio, _engine(key), key % 2 != 0).alias("wall"))


@query("estimate_wall", f"SELECT doc_id, round(wall, 4)::DOUBLE AS wall FROM ({_WALL})")
def estimate_wall(spark, d):
    return _estimates(spark, d).select("doc_id", F.round("wall", 4).alias("wall"))


@query("estimate_job", f"SELECT doc_id, chars::BIGINT AS chars, engine, round(audio, 4)::DOUBLE AS audio_s, round(wall, 4)::DOUBLE AS wall_s, round(audio / wall, 4)::DOUBLE AS speedup FROM ({_WALL})")
def estimate_job(spark, d):
    job = _estimates(spark, d).select(F.struct("doc_id", "chars", "engine", F.round("audio", 4).alias("audio_s"), F.round("wall", 4).alias("wall_s"), F.round(F.try_divide("audio", "wall"), 4).alias("speedup")).alias("job"))
    return job.select("job.*")


@query("estimate_size_mb", f"SELECT doc_id, round(length(text) * CASE {_ENGINE_SQL} WHEN 'edge' THEN 520 WHEN 'piper' THEN 6000 WHEN 'chatterbox_fi' THEN 8000 ELSE 2000 END / 1048576.0, 6)::DOUBLE AS mb FROM documents")
def estimate_size_mb(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(F.length("text") * S.lookup(S.BYTES_PER_CHAR, _engine(F.col("doc_id")), S.OTHER_BYTES) / 1048576.0, 6).alias("mb"))


@query("format_duration", """SELECT event_id, CASE WHEN s IS NULL THEN '?' WHEN s <= 0 THEN '0 s' WHEN s < 60 THEN round_even(s, 0)::BIGINT || ' s'
  WHEN s < 3600 THEN CASE WHEN rs = 60 THEN (m + 1) || ' min 0 s' ELSE m || ' min ' || rs || ' s' END
  ELSE CASE WHEN rm = 60 THEN (h + 1) || ' h 0 min' ELSE h || ' h ' || rm || ' min' END END AS label
FROM (SELECT *, round_even(s - m * 60, 0)::BIGINT AS rs, round_even((s - h * 3600) / 60, 0)::BIGINT AS rm FROM
  (SELECT *, floor(s / 60)::BIGINT AS m, floor(s / 3600)::BIGINT AS h FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN (event_id * 3) % 9000 / 2.0 - 10 END::DOUBLE AS s FROM events)))""")
def format_duration(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", S.format_duration(F.when(e % 50 != 0, (e * 3) % 9000 / 2.0 - 10)).alias("label"))


@query("format_hms", """SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || lpad((s % 60)::VARCHAR, 2, '0') || 's'
  ELSE (s // 3600) || 'h' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' END AS label FROM (SELECT event_id, (event_id * 7) % 20000 AS s FROM events)""")
def format_hms(spark, d):
    return table(spark, d, "events").select("event_id", S.format_hms((F.col("event_id") * 7) % 20000).alias("label"))


@query("parse_hms", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE (event_id % 4) * 3600 + (event_id % 60) * 60 + event_id % 50 END AS seconds FROM events")
def parse_hms(spark, d):
    e = F.col("event_id")
    text = F.when(e % 7 == 0, F.concat(F.lit("x"), e.cast("string"))).otherwise(F.concat((e % 4).cast("string"), F.lit("h"), (e % 60).cast("string"), F.lit("m"), (e % 50).cast("string"), F.lit("s")))
    return table(spark, d, "events").select("event_id", S.parse_hms(text).alias("seconds"))


@query("format_age", "SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM (SELECT event_id, epoch(TIMESTAMP '2024-02-15 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)")
def format_age(spark, d):
    now = F.unix_timestamp(F.lit("2024-02-15 00:00:00").cast("timestamp"))
    return table(spark, d, "events").select("event_id", S.format_age(now - F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)).alias("age"))


@query("parse_version", "SELECT l_orderkey, l_linenumber, ([l_linenumber::BIGINT, l_orderkey % 12, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_orderkey % 7 END])::VARCHAR AS version, l_linenumber > 3 OR (l_linenumber = 3 AND (l_orderkey % 12 > 4 OR (l_orderkey % 12 = 4 AND CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_orderkey % 7 END > 2))) AS newer FROM lineitem")
def parse_version(spark, d):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    text = F.concat(F.lit("v"), n.cast("string"), F.lit("."), (o % 12).cast("string"), F.lit("."), F.when(o % 5 == 0, "beta").otherwise((o % 7).cast("string")))
    key = S.version_key(text)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("["), F.array_join(key.cast("array<string>"), ", "), F.lit("]")).alias("version"), (key > S.version_key(F.lit("v3.4.2"))).alias("newer"))


@query("extract_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 4 = 0")
def extract_sha256(spark, d):
    notes = F.concat(F.lit("Notes.\nSHA-256: "), F.when(F.col("doc_id") % 4 == 0, "none").otherwise(F.upper(F.sha2("text", 256))), F.lit("  setup.exe"))
    found = F.lower(F.regexp_extract(notes, r"(?i)\b([0-9a-f]{64})\b", 1))
    return table(spark, d, "documents").select("doc_id", F.nullif(found, F.lit("")).alias("digest"))


@query("trim_to_sentence_start", r"""SELECT doc_id, CASE WHEN regexp_matches(t, '^["''(«\p{Lu}]') THEN t WHEN regexp_matches(t, '[.!?…]\s+[A-ZÅÄÖ]') THEN regexp_extract(t, '(?s)[.!?…]\s+([A-ZÅÄÖ].*)$', 1) ELSE t END AS t
FROM (SELECT doc_id, substring(text, 2) AS t FROM documents)""")
def trim_to_sentence_start(spark, d):
    return table(spark, d, "documents").select("doc_id", S.sentence_start(F.expr("substring(text, 2)")).alias("t"))


@query("extract_sample", r"""WITH a AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, t, left(t, 500) AS h, regexp_extract(left(t, 500), '(?s)^(.*[.!?])[ \n]', 1) AS c FROM a)
SELECT doc_id, CASE WHEN length(t) <= 500 THEN t WHEN length(c) - 1 >= 100 THEN c ELSE regexp_replace(h, '\s+$', '') END AS sample FROM b""")
def extract_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", S.sample_text(F.col("text")).alias("sample"))


@query("voice_gender", "SELECT c_custkey, CASE WHEN lower(n) LIKE '%female%' THEN 'Female' WHEN lower(n) LIKE '%male%' THEN 'Male' ELSE 'Unknown' END AS gender FROM (SELECT c_custkey, c_name || ([' (Female)', ' Male voice', ''])[c_custkey % 3 + 1] AS n FROM customer)")
def voice_gender(spark, d):
    name = F.lower(F.concat("c_name", F.element_at(F.array(F.lit(" (Female)"), F.lit(" Male voice"), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int"))))
    return table(spark, d, "customer").select("c_custkey", F.when(name.contains("female"), "Female").when(name.contains("male"), "Male").otherwise("Unknown").alias("gender"))


@query("build_issue_url", "SELECT p_partkey, 'https://issues.example.org/new?title=' || replace(url_encode(p_name || ' #' || p_size), '%20', '+') AS url FROM part")
def build_issue_url(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("https://issues.example.org/new?title="), F.url_encode(F.concat("p_name", F.lit(" #"), F.col("p_size").cast("string")))).alias("url"))


@query("description_prefix", r"""SELECT doc_id, CASE WHEN s = '' THEN '' WHEN starts_with(s, '(') AND ends_with(s, ')') AND length(s) > 1 THEN CASE WHEN trim(s[2:-2]) = '' THEN '' ELSE '(' || trim(s[2:-2]) || ')' END ELSE '(' || s || ')' END AS prefix
FROM (SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN ' ( ' || text || ' ) ' WHEN 1 THEN text || ' (low)' WHEN 2 THEN '  (  ) ' ELSE text END, chr(10) || chr(9) || chr(13) || ' ') AS s FROM documents)""")
def description_prefix(spark, d):
    k, t = F.col("doc_id") % 4, F.col("text")
    said = F.when(k == 0, F.concat(F.lit(" ( "), t, F.lit(" ) "))).when(k == 1, F.concat(t, F.lit(" (low)"))).when(k == 2, "  (  ) ").otherwise(t)
    return table(spark, d, "documents").select("doc_id", S.description_prefix(said).alias("prefix"))


@query("short_audio_guard", f"""WITH {D.STATS_SQL} SELECT job, count(*) FILTER (input_chars >= 50 AND audio_ms < 40 * input_chars) AS suspect, max(audio_ms) AS kept_audio_ms, arg_max(n, audio_ms * 1000000 - n) AS kept_n FROM stats GROUP BY job""")
def short_audio_guard(spark, d):
    s = D.chunk_stats(spark, d)
    short = (F.col("input_chars") >= 50) & (F.col("audio_ms") < 40 * F.col("input_chars"))
    return s.groupBy("job").agg(F.count(F.when(short, 1)).alias("suspect"), F.max("audio_ms").alias("kept_audio_ms"), F.max_by("n", F.struct("audio_ms", -F.col("n"))).alias("kept_n"))


@query("filter_speaker_character", f"WITH {D.TURNS_SQL} SELECT source_id, turn_idx, speaker, character FROM (SELECT *, 'CHAR_' || chr(CAST(65 + turn_idx % 3 AS INTEGER)) AS character FROM turn) WHERE speaker = 'SPEAKER_02' AND character = 'CHAR_B'")
def filter_speaker_character(spark, d):
    from weftline.operators.speech import export_filter

    t = D.turns(spark, d).withColumn("character", F.concat(F.lit("CHAR_"), S.char_label(F.col("turn_idx") % 3)))
    return export_filter(t, "SPEAKER_02", "CHAR_B").select("source_id", "turn_idx", "speaker", "character")


@query("looks_like_heading", f"WITH {Q.LINES} SELECT doc_id, n, {Q.heading('s')} AS heading FROM (SELECT doc_id, n, trim(line) AS s FROM l) WHERE s <> ''")
def looks_like_heading(spark, d):
    from weftline.operators.text import heading, lines_with_headings

    s = F.trim("line")
    return lines_with_headings(spread(table(spark, d, "documents").select("doc_id", "text"))).where(s != "").select("doc_id", "n", heading(s).alias("heading"))
