"""Queries of joins, aggregates, windows, ranking and set operations over speech records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import speech as P
from weftline.plans.registry import query
from weftline.session import table
from weftline.sources import derived as D

_JOINED = f"""{D.SEGMENTS_SQL}, {D.TURNS_SQL}, pairs AS (SELECT seg.*, speaker, least(e_ms, te_ms) - greatest(s_ms, ts_ms) AS overlap_ms,
  row_number() OVER (PARTITION BY seg.source_id, seg_idx ORDER BY least(e_ms, te_ms) - greatest(s_ms, ts_ms) DESC, ts_ms, turn_idx) AS r
  FROM seg JOIN turn ON seg.source_id = turn.source_id AND s_ms < te_ms AND ts_ms < e_ms), chunk AS (SELECT * FROM pairs WHERE r = 1)"""
_GOOD = f"{_JOINED}, good AS (SELECT * FROM chunk WHERE e_ms - s_ms BETWEEN 1000 AND 30000 AND confidence >= 0.3 AND trim(text) <> '')"
_TIER = "CASE WHEN {0} >= 1800 THEN 'full_lora' WHEN {0} >= 600 THEN 'reduced_lora' WHEN {0} >= 60 THEN 'few_shot' ELSE 'skip' END"


def _chunks(spark, d):
    return P.assign_speakers(D.segments(spark, d), D.turns(spark, d))


@query("assign_speakers", f"WITH {_JOINED} SELECT source_id, seg_idx, s_ms, e_ms, speaker, overlap_ms FROM chunk")
def assign_speakers(spark, d):
    return _chunks(spark, d).select("source_id", "seg_idx", "s_ms", "e_ms", "speaker", "overlap_ms")


@query("summarize_speakers", f"WITH {_GOOD} SELECT source_id, speaker, ms / 1000 AS total_seconds, n AS chunk_count, round(ms / 1000 / n, 6) AS mean_chunk_seconds, {_TIER.format('(ms / 1000)')} AS quality_tier FROM (SELECT source_id, speaker, sum(e_ms - s_ms)::BIGINT AS ms, count(*) AS n FROM good GROUP BY ALL)")
def summarize_speakers(spark, d):
    return P.summarize_speakers(P.quality_filter(_chunks(spark, d)))


@query("sort_speakers", f"WITH {_GOOD} SELECT speaker, ms / 1000 AS total_seconds, row_number() OVER (ORDER BY ms DESC, speaker) AS place FROM (SELECT speaker, sum(e_ms - s_ms)::BIGINT AS ms FROM good GROUP BY ALL)")
def sort_speakers(spark, d):
    s = P.summarize_speakers(P.quality_filter(_chunks(spark, d)), "speaker")
    return s.select("speaker", "total_seconds", F.row_number().over(W.orderBy(F.desc("total_seconds"), "speaker")).alias("place"))


@query("sort_by_start", f"WITH {_JOINED} SELECT source_id, seg_idx, row_number() OVER (PARTITION BY source_id ORDER BY s_ms, seg_idx) AS place FROM chunk")
def sort_by_start(spark, d):
    return _chunks(spark, d).select("source_id", "seg_idx", F.row_number().over(W.partitionBy("source_id").orderBy("s_ms", "seg_idx")).alias("place"))


_EMB = "emb AS (SELECT vec_id AS idx, 'L' || label AS speaker, embedding::DOUBLE[] AS v FROM embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("speaker"), F.col("embedding").cast("array<double>").alias("v"))


@query("join_embeddings", "SELECT event_id, CASE WHEN label IS NOT NULL THEN 'CHAR_' || chr(65 + label) ELSE 'prior_' || event_id % 3 END AS character FROM events LEFT JOIN embeddings ON event_id = vec_id AND vec_id % 2 = 0")
def join_embeddings(spark, d):
    e = table(spark, d, "embeddings").where("vec_id % 2 = 0").select("vec_id", "label")
    c = table(spark, d, "events").select("event_id").join(e, F.col("event_id") == F.col("vec_id"), "left")
    named = F.concat(F.lit("CHAR_"), S.char_label(F.col("label")))
    return c.select("event_id", F.coalesce(named, F.concat(F.lit("prior_"), (F.col("event_id") % 3).cast("string"))).alias("character"))


@query("l2_normalize", f"WITH {_EMB} SELECT idx, round(list_sum([x / n * (i % 3) for x, i in v]), 6) AS checksum, round(list_sum([x * x / (n * n) for x in v]), 6) AS norm FROM (SELECT *, sqrt(list_sum([x * x for x in v])) AS n FROM emb)")
def l2_normalize(spark, d):
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    u = _vectors(spark, d).withColumn("u", F.transform("v", lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return u.select("idx", total(F.transform("u", lambda x, i: x * ((i + 1) % 3))).alias("checksum"), total(F.transform("u", lambda x: x * x)).alias("norm"))


@query("cosine_distance", f"WITH {_EMB} SELECT a.idx AS a, b.idx AS b, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM emb a JOIN emb b ON b.idx = a.idx + 1")
def cosine_distance(spark, d):
    v = _vectors(spark, d)
    x, y = v.select(F.col("idx").alias("a"), F.col("v").alias("x")), v.select((F.col("idx") - 1).alias("a"), F.col("idx").alias("b"), F.col("v").alias("y"))
    return x.join(y, "a").select("a", "b", F.round(1 - S.cosine(F.col("x"), F.col("y")), 6).alias("distance"))


@query("pairwise_similarity", f"WITH {_EMB} SELECT a.speaker, a.idx AS a, b.idx AS b FROM emb a JOIN emb b ON a.speaker = b.speaker AND a.idx < b.idx WHERE 1 - list_cosine_similarity(a.v, b.v) <= 0.75")
def pairwise_similarity(spark, d):
    return P.similar_pairs(_vectors(spark, d), 0.75).select("speaker", "a", "b")


_COMP = f"""{_EMB}, e AS (SELECT a.speaker, a.idx AS a, b.idx AS b FROM emb a JOIN emb b ON a.speaker = b.speaker AND a.idx <> b.idx WHERE 1 - list_cosine_similarity(a.v, b.v) <= 0.7),
reach(speaker, v, w) AS (SELECT speaker, idx, idx FROM emb UNION SELECT r.speaker, r.v, e.b FROM reach r JOIN e ON e.speaker = r.speaker AND e.a = r.w),
comp AS (SELECT speaker, v AS idx, min(w) AS root FROM reach GROUP BY ALL)"""


def _components(spark, d):
    v = _vectors(spark, d)
    return P.connected_labels(v, P.similar_pairs(v, 0.7))


@query("connected_components", f"WITH RECURSIVE {_COMP} SELECT speaker, idx, root FROM comp")
def connected_components(spark, d):
    return _components(spark, d)


@query("relabel_first_seen", f"WITH RECURSIVE {_COMP} SELECT speaker, idx, dense_rank() OVER (PARTITION BY speaker ORDER BY root) - 1 AS label FROM comp")
def relabel_first_seen(spark, d):
    return P.first_seen_labels(_components(spark, d)).select("speaker", "idx", F.col("label").cast("long").alias("label"))


_CLUSTERS = "cl AS (SELECT 'S' || user_id % 4 AS speaker, CASE WHEN event_id % 11 < 6 THEN 0 ELSE event_id % 7 END AS cluster, 1 + event_id % 7 AS seconds FROM events)"
_RANKED = f"""{_CLUSTERS}, g AS (SELECT speaker, cluster, sum(seconds)::BIGINT AS s, count(*) AS n FROM cl GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY s DESC, n DESC, cluster) AS k FROM g),
k AS (SELECT *, k = 1 OR (n >= 100 AND s >= 420) AS ok FROM r), named AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY speaker ORDER BY k) - 1 AS no FROM k)"""
_NAME = "'CHAR_' || CASE WHEN ok AND no < 4 THEN chr(CAST(65 + no AS INTEGER)) ELSE 'A' END"


def _clustered(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("speaker"), F.when(e % 11 < 6, 0).otherwise(e % 7).alias("cluster"), (1 + e % 7).alias("seconds"))


@query("cluster_rank_and_fold", f"WITH {_RANKED} SELECT speaker, cluster, {_NAME} AS name FROM named")
def cluster_rank_and_fold(spark, d):
    return P.fold_clusters(_clustered(spark, d), least_chunks=100, least_seconds=420, most=4)


@query("character_summary", f"WITH {_RANKED}, t AS (SELECT speaker, {_NAME} AS character, s, n FROM named) SELECT speaker, character, sum(s)::BIGINT AS total_seconds, sum(n)::BIGINT AS chunks, round(sum(s) / sum(n), 6) AS mean_seconds FROM t GROUP BY ALL")
def character_summary(spark, d):
    c = _clustered(spark, d)
    named = c.join(P.fold_clusters(c, least_chunks=100, least_seconds=420, most=4), ["speaker", "cluster"])
    return named.groupBy("speaker", F.col("name").alias("character")).agg(F.sum("seconds").alias("total_seconds"), F.count("*").alias("chunks"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))


@query("char_label", "SELECT p_partkey, CASE WHEN n < 26 THEN chr(CAST(65 + n AS INTEGER)) ELSE chr(CAST(64 + n // 26 AS INTEGER)) || chr(CAST(65 + n % 26 AS INTEGER)) END AS label FROM (SELECT p_partkey, p_partkey % 700 AS n FROM part)")
def char_label(spark, d):
    return table(spark, d, "part").select("p_partkey", S.char_label(F.col("p_partkey") % 700).alias("label"))


@query("undersplit_warning", f"WITH cl AS (SELECT 'S' || user_id % 4 AS speaker, CASE WHEN user_id % 4 = 1 OR event_id % 11 < 6 THEN 0 ELSE event_id % 7 END AS cluster FROM events), k AS (SELECT speaker, count(*) AS chunks, count(DISTINCT cluster) AS characters FROM cl GROUP BY ALL) SELECT * FROM k WHERE chunks >= 50 AND characters <= 1")
def undersplit_warning(spark, d):
    """One of four speakers has a single cluster."""
    c = _clustered(spark, d).withColumn("cluster", F.when(F.col("speaker") == "S1", 0).otherwise(F.col("cluster")))
    named = c.join(P.fold_clusters(c, least_chunks=1, least_seconds=0), ["speaker", "cluster"])
    return P.undersplit(named)


@query("decision_join", f"WITH {D.TURNS_SQL}, s AS (SELECT speaker, count(*) AS n FROM turn GROUP BY ALL), dec AS (SELECT 'SPEAKER_' || lpad(n_nationkey::VARCHAR, 2, '0') AS speaker, CASE WHEN n_nationkey % 4 = 3 THEN ' ' ELSE n_name END AS name, n_nationkey % 5 = 4 AS excluded FROM nation) SELECT s.speaker, n, CASE WHEN NOT excluded AND trim(name) <> '' THEN name END AS name, NOT coalesce(NOT excluded AND trim(name) <> '', false) AS skipped FROM s LEFT JOIN dec USING (speaker)")
def decision_join(spark, d):
    s = D.turns(spark, d).groupBy("speaker").agg(F.count("*").alias("n"))
    k = F.col("n_nationkey")
    dec = table(spark, d, "nation").select(F.concat(F.lit("SPEAKER_"), F.lpad(k.cast("string"), 2, "0")).alias("speaker"), F.when(k % 4 == 3, " ").otherwise(F.col("n_name")).alias("name"), (k % 5 == 4).alias("excluded"))
    ok = F.coalesce(~F.col("excluded") & (F.trim("name") != ""), F.lit(False))
    return s.join(dec, "speaker", "left").select("speaker", "n", F.when(ok, F.col("name")).alias("name"), (~ok).alias("skipped"))


@query("resume_anti", f"WITH {D.STATS_SQL} SELECT job, n FROM stats WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = n AND l_linenumber = job % 7 + 1)")
def resume_anti(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("n"), F.col("l_linenumber").alias("k"))
    plan = D.chunk_stats(spark, d).select("job", "n", (F.col("job") % 7 + 1).cast("int").alias("k"))
    return plan.join(done, ["n", "k"], "left_anti").select("job", "n")


@query("orphan_detect", "SELECT DISTINCT s_nationkey, s_name[:12] AS path FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 1)")
def orphan_detect(spark, d):
    wanted = table(spark, d, "customer").where("c_custkey % 50 = 1").select(F.col("c_nationkey").alias("s_nationkey"))
    return P.orphans(table(spark, d, "supplier").select("s_nationkey", F.substring("s_name", 1, 12).alias("path")), wanted, "s_nationkey")


@query("resume", f"WITH {D.STATS_SQL}, p AS (SELECT job, count(*) AS planned, count(*) FILTER (n % 3 = 0) AS cached FROM stats GROUP BY job) SELECT job, planned, cached, planned - cached AS todo, cached = planned AS complete FROM p")
def resume(spark, d):
    p = D.chunk_stats(spark, d).groupBy("job").agg(F.count("*").alias("planned"), F.count(F.when(F.col("n") % 3 == 0, 1)).alias("cached"))
    return p.select("job", "planned", "cached", (F.col("planned") - F.col("cached")).alias("todo"), (F.col("planned") == F.col("cached")).alias("complete"))


@query("merge_turns", f"""WITH {D.TURNS_SQL}, a AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS nw FROM turn WINDOW w AS (PARTITION BY source_id ORDER BY ts_ms, turn_idx)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY source_id ORDER BY ts_ms, turn_idx) AS run FROM a),
c AS (SELECT *, max(te_ms) OVER (PARTITION BY source_id, run ORDER BY ts_ms, turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
e AS (SELECT *, sum(CASE WHEN reach IS NULL OR ts_ms - reach >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, run ORDER BY ts_ms, turn_idx) AS island FROM c)
SELECT source_id, speaker, min(ts_ms) AS ts_ms, max(te_ms) AS te_ms, count(*) AS merged FROM e GROUP BY source_id, run, island, speaker""")
def merge_turns(spark, d):
    return P.merge_turns(D.turns(spark, d)).select("source_id", "speaker", "ts_ms", "te_ms", "merged")


@query("merge_windows", """WITH t AS (SELECT event_id % 20 AS source_id, event_id // 20 * 750 + CASE WHEN event_id % 13 = 0 THEN 1300 ELSE 0 END AS ts_ms, user_id % 3 AS label FROM events),
a AS (SELECT *, ts_ms + 1500 AS te_ms, CASE WHEN lag(label) OVER w = label THEN 0 ELSE 1 END AS nw FROM t WINDOW w AS (PARTITION BY source_id ORDER BY ts_ms, label)),
b AS (SELECT *, sum(nw) OVER (PARTITION BY source_id ORDER BY ts_ms, label ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, max(te_ms) OVER (PARTITION BY source_id, run ORDER BY ts_ms, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
e AS (SELECT *, sum(CASE WHEN reach IS NULL OR ts_ms > reach + 500 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, run ORDER BY ts_ms, label ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT source_id, 'SPEAKER_' || lpad(label::VARCHAR, 2, '0') AS speaker, min(ts_ms) AS ts_ms, max(te_ms) AS te_ms, count(*) AS merged FROM e GROUP BY source_id, run, island, label""")
def merge_windows(spark, d):
    e = F.col("event_id")
    t = table(spark, d, "events").select((e % 20).alias("source_id"), (F.floor(e / 20) * 750 + F.when(e % 13 == 0, 1300).otherwise(0)).alias("ts_ms"), (F.col("user_id") % 3).alias("label"))
    m = P.merge_windows(t.withColumn("te_ms", F.col("ts_ms") + 1500))
    return m.select("source_id", F.concat(F.lit("SPEAKER_"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("speaker"), "ts_ms", "te_ms", "merged")


@query("pick_reference", f"""WITH {_JOINED}, m AS (SELECT source_id, max(e_ms) AS z FROM chunk GROUP BY 1), s AS (SELECT chunk.*, z, e_ms - s_ms AS len FROM chunk JOIN m USING (source_id)),
p AS (SELECT source_id, speaker, seg_idx, round((CASE WHEN len < 12000 THEN 12000 - len WHEN len > 18000 THEN len - 18000 ELSE 0 END
 + 0.5 * (CASE WHEN s_ms < 5000 THEN 5000 - s_ms ELSE 0 END + CASE WHEN e_ms > z - 5000 THEN e_ms - z + 5000 ELSE 0 END)) / 1000.0::DOUBLE + 3.0, 6) AS score,
 array_to_string([x for x in [CASE WHEN len < 12000 THEN 'too_short' WHEN len > 18000 THEN 'too_long' END, CASE WHEN s_ms < 5000 THEN 'intro' END, CASE WHEN e_ms > z - 5000 THEN 'outro' END, 'too_few_words'] if x is not null], ',') AS penalties FROM s)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, speaker ORDER BY score, seg_idx) AS rank FROM p) WHERE rank <= 3""")
def pick_reference(spark, d):
    return P.pick_reference(_chunks(spark, d)).select("source_id", "speaker", "seg_idx", "score", "penalties", "rank")


@query("rebalance", f"WITH {D.TAGGED_SQL}, g AS (SELECT emotion, count(*) AS n FROM tagged GROUP BY ALL) SELECT emotion, (SELECT max(n) FROM g) AS clips, n AS different FROM g WHERE n * 1 > 0 AND true")
def rebalance(spark, d):
    out = P.rebalance(D.tagged(spark, d))
    return out.groupBy("emotion").agg(F.count("*").alias("clips"), F.count_distinct("clip_id").alias("different"))


@query("rebalance_down", f"WITH {D.TAGGED_SQL} SELECT emotion, 300::BIGINT AS clips FROM tagged GROUP BY emotion")
def rebalance_down(spark, d):
    return P.rebalance(D.tagged(spark, d), 300).groupBy("emotion").agg(F.count("*").alias("clips"))


@query("emotion_counts", f"WITH {D.TAGGED_SQL} SELECT speaker, string_agg(emotion || '=' || n, ',' ORDER BY emotion) AS counts, sum(ms)::BIGINT AS ms FROM (SELECT speaker, emotion, count(*) AS n, sum(ms) AS ms FROM tagged GROUP BY ALL) GROUP BY speaker")
def emotion_counts(spark, d):
    g = D.tagged(spark, d).groupBy("speaker", "emotion").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))
    m = g.groupBy("speaker").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("emotion", "n")))).alias("m"), F.sum("ms").alias("ms"))
    return m.select("speaker", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"), "ms")


@query("stride_sample", "WITH t AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, user_id, i FROM t WHERE n <= 9 OR list_contains([(k * n) // 9 for k in range(9)], i)")
def stride_sample(spark, d):
    return P.stride_sample(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 9).select("event_id", "user_id", F.col("i").cast("long").alias("i"))


@query("overlap_duration", f"WITH {D.TURNS_SQL}, t AS (SELECT *, max(te_ms) OVER (PARTITION BY source_id ORDER BY ts_ms, turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM turn) SELECT source_id, sum(greatest(0, te_ms - greatest(ts_ms, coalesce(reach, ts_ms))))::BIGINT AS speech_ms, sum(CASE WHEN ts_ms > reach THEN ts_ms - reach ELSE 0 END)::BIGINT AS silence_ms, count(*) FILTER (ts_ms > reach) AS gaps FROM t GROUP BY source_id")
def overlap_duration(spark, d):
    before = W.partitionBy("source_id").orderBy("ts_ms", "turn_idx").rowsBetween(W.unboundedPreceding, -1)
    t = D.turns(spark, d).withColumn("reach", F.max("te_ms").over(before))
    new = F.greatest(F.lit(0), F.col("te_ms") - F.greatest("ts_ms", F.coalesce("reach", "ts_ms")))
    gap = F.col("ts_ms") > F.col("reach")
    return t.groupBy("source_id").agg(F.sum(new).alias("speech_ms"), F.sum(F.when(gap, F.col("ts_ms") - F.col("reach")).otherwise(0)).alias("silence_ms"), F.count(F.when(gap, 1)).alias("gaps"))


@query("spine_union", "SELECT n_name AS item, 0 AS origin FROM nation WHERE n_nationkey IN (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 9 = 0) UNION ALL SELECT n_name, 1 FROM nation WHERE n_nationkey NOT IN (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 9 = 0)")
def spine_union(spark, d):
    spine = table(spark, d, "customer").where("c_custkey % 9 = 0").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    all_ = table(spark, d, "nation")
    first = all_.join(spine, "n_nationkey", "left_semi").select(F.col("n_name").alias("item"), F.lit(0).alias("origin"))
    return first.unionByName(all_.join(spine, "n_nationkey", "left_anti").select(F.col("n_name").alias("item"), F.lit(1).alias("origin")))


@query("fuzzy_best_match")
def fuzzy_best_match(spark, d):
    names = [r[0] for r in table(spark, d, "region").orderBy("r_regionkey").select("r_name").collect()]  # five rows
    return P.fuzzy_matches(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("text")), names)


@query("realign")
def realign(spark, d):
    c = table(spark, d, "conversations")
    parts = F.posexplode(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")).alias("k", "sentence")
    refs = c.select(F.col("conv_id").alias("source_id"), "turn", parts).select("source_id", (F.col("turn") * 100000 + F.col("k")).alias("n"), "sentence")
    segs = refs.where("n % 3 <> 1").select("source_id", F.col("n").alias("seg_idx"), F.regexp_replace("sentence", "[aeiou]([a-z])", "$1").alias("text"))
    return P.realign(segs, refs)


@query("cluster_k_or_threshold")
def cluster_k_or_threshold(spark, d):
    """Vectors by a given number of clusters, and by a distance threshold within each source."""
    v = _vectors(spark, d)
    by_k = P.cluster_by_number(v, 5, starts=3).select(F.lit("k").alias("how"), F.lit("all").alias("source"), "idx", F.col("cluster").cast("long").alias("cluster"))
    sources = v.withColumn("source", F.concat("speaker", F.lit("/"), F.floor(F.col("idx") / 200).cast("string")))
    by_t = P.cluster_by_threshold(sources, 0.8, key="source").select(F.lit("threshold").alias("how"), "source", "idx", "cluster")
    return by_k.unionByName(by_t)


@query("speaker_index", f"WITH {D.TURNS_SQL} SELECT speaker, 'Narrator ' || row_number() OVER (ORDER BY sum(te_ms - ts_ms) DESC, speaker) AS label FROM turn GROUP BY speaker")
def speaker_index(spark, d):
    g = D.turns(spark, d).groupBy("speaker").agg(F.sum(F.col("te_ms") - F.col("ts_ms")).alias("ms"))
    return g.select("speaker", F.concat(F.lit("Narrator "), F.row_number().over(W.orderBy(F.desc("ms"), "speaker")).cast("string")).alias("label"))
