"""Queries of aggregates and windows over synthesis statistics and signal frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import signal as G
from weftline.operators.ranking import placed
from weftline.plans.registry import query
from weftline.session import table
from weftline.sources import derived as D

_ST, _FR = f"WITH {D.STATS_SQL} ", f"WITH {D.FRAMES_SQL} "


@query("chunk_stats_rollup", _ST + "SELECT job, count(*) AS chunks, round(sum(synth_ms) / nullif(sum(audio_ms), 0), 6) AS rtf, round(sum(audio_ms) / 1000.0 / sum(input_chars), 6)::DOUBLE AS s_per_char, round(sum(synth_ms) / 1000.0 / count(*) * 40, 6)::DOUBLE AS eta_s FROM stats GROUP BY job")
def chunk_stats_rollup(spark, d):
    g = D.chunk_stats(spark, d).groupBy("job").agg(F.count("*").alias("chunks"), F.sum("synth_ms").alias("s"), F.sum("audio_ms").alias("a"), F.sum("input_chars").alias("c"))
    return g.select("job", "chunks", F.round(F.try_divide("s", "a"), 6).alias("rtf"), F.round(F.col("a") / 1000 / F.col("c"), 6).alias("s_per_char"), F.round(F.col("s") / 1000 / F.col("chunks") * 40, 6).alias("eta_s"))


@query("percentiles", _ST + "SELECT job, round(quantile_cont(audio_ms, 0.1), 6) AS p10, round(quantile_cont(audio_ms, 0.5), 6) AS p50, round(quantile_cont(audio_ms, 0.9), 6) AS p90, round(avg(audio_ms), 6) AS mean FROM stats GROUP BY job")
def percentiles(spark, d):
    p = lambda q: F.round(F.percentile("audio_ms", q), 6)
    return D.chunk_stats(spark, d).groupBy("job").agg(p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.round(F.avg("audio_ms"), 6).alias("mean"))


@query("median_outlier", _ST + ", m AS (SELECT job, median(audio_ms) AS mid FROM stats GROUP BY job) SELECT job, round(any_value(mid), 6) AS mid, count(*) AS short, min(n) AS first_n FROM stats JOIN m USING (job) WHERE audio_ms < 0.75 * mid GROUP BY job")
def median_outlier(spark, d):
    s = D.chunk_stats(spark, d)
    m = s.groupBy("job").agg(F.median("audio_ms").alias("mid"))
    return s.join(m, "job").where(F.col("audio_ms") < 0.75 * F.col("mid")).groupBy("job").agg(F.round(F.first("mid"), 6).alias("mid"), F.count("*").alias("short"), F.min("n").alias("first_n"))


_TREND = _ST + """, r AS (SELECT job, n, synth_ms, row_number() OVER (PARTITION BY job ORDER BY n) AS i, greatest(1, count(*) OVER (PARTITION BY job) // 4) AS q, count(*) OVER (PARTITION BY job) AS c FROM stats),
t AS (SELECT job, avg(synth_ms) FILTER (i <= q) AS f, avg(synth_ms) FILTER (i > c - q) AS l FROM r GROUP BY job) """


@query("quarter_trend", _TREND + "SELECT job, round(f, 6) AS first, round(l, 6) AS last, round(l - f, 6) AS delta FROM t")
def quarter_trend(spark, d):
    t = G.quarter_trend(D.chunk_stats(spark, d), "job", "n", "synth_ms")
    return t.select("job", *[F.round(c, 6).alias(c) for c in ("first", "last", "delta")])


@query("growth_check", _TREND + "SELECT job, f > 0 AND l > f * 1.15 AS grew FROM t")
def growth_check(spark, d):
    t = G.quarter_trend(D.chunk_stats(spark, d), "job", "n", "synth_ms")
    return t.select("job", ((F.col("first") > 0) & (F.col("last") > F.col("first") * 1.15)).alias("grew"))


@query("threshold_breach", _ST + "SELECT job, min(n) AS \"at\", arg_min(hook_count, n) AS hooks FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY n) AS i FROM stats) WHERE i > 1 AND hook_count > 3 GROUP BY job")
def threshold_breach(spark, d):
    s = D.chunk_stats(spark, d).withColumn("i", F.row_number().over(W.partitionBy("job").orderBy("n")))
    return s.where("i > 1 and hook_count > 3").groupBy("job").agg(F.min("n").alias("at"), F.min_by("hook_count", "n").alias("hooks"))


@query("eta_running", _ST + "SELECT job, n, (sum(synth_ms) OVER (PARTITION BY job ORDER BY n ROWS UNBOUNDED PRECEDING) * (count(*) OVER (PARTITION BY job) - row_number() OVER (PARTITION BY job ORDER BY n)) // row_number() OVER (PARTITION BY job ORDER BY n))::BIGINT AS eta_ms FROM stats")
def eta_running(spark, d):
    w = W.partitionBy("job")
    o = w.orderBy("n")
    i = F.row_number().over(o)
    so_far = F.sum("synth_ms").over(o.rowsBetween(W.unboundedPreceding, 0)) * (F.count("*").over(w) - i)
    return D.chunk_stats(spark, d).select("job", "n", so_far.alias("s"), i.cast("long").alias("i")).select("job", "n", F.expr("s div i").alias("eta_ms"))


@query("audio_windows", _ST + ", t AS (SELECT job, sum(audio_ms) OVER (PARTITION BY job ORDER BY n ROWS UNBOUNDED PRECEDING) - audio_ms AS pos, audio_ms FROM stats) SELECT job, (pos // 300000)::BIGINT AS w, count(*) AS chunks, sum(audio_ms)::BIGINT AS ms FROM t GROUP BY ALL")
def audio_windows(spark, d):
    at = F.sum("audio_ms").over(W.partitionBy("job").orderBy("n").rowsBetween(W.unboundedPreceding, 0)) - F.col("audio_ms")
    return D.chunk_stats(spark, d).select("job", F.floor(at / 300000).alias("w"), "audio_ms").groupBy("job", "w").agg(F.count("*").alias("chunks"), F.sum("audio_ms").alias("ms"))


@query("hop_windows", "WITH t AS (SELECT event_id * 250 AS pos, value FROM events), e AS (SELECT max(pos) + 250 AS z FROM t), w AS (SELECT unnest(range(0, (SELECT z FROM e) - 1500 + 1, 750)) AS s) SELECT s::BIGINT AS start_ms, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms FROM w JOIN t ON pos >= s AND pos < s + 1500 GROUP BY s HAVING sqrt(avg(value * value)) >= 0.005")
def hop_windows(spark, d):
    t = table(spark, d, "events").select((F.col("event_id") * 250).alias("at"), "value")
    end = t.agg((F.max("at") + 250).alias("z"))
    # each frame lies in the windows that begin at most 1500 ms before it
    s = t.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - 1500) / 750) + 1), F.floor(F.col("at") / 750))))
    g = s.groupBy((F.col("w") * 750).alias("start_ms")).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return g.join(F.broadcast(end), F.col("start_ms") + 1500 <= F.col("z")).where("rms >= 0.005").select("start_ms", "n", F.round("rms", 6).alias("rms"))


@query("anomaly_first_drop", _ST + ", r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY n) AS i, count(*) OVER (PARTITION BY job) AS c FROM stats), b AS (SELECT job, median(audio_ms) FILTER (i <= c // 2) AS base FROM r GROUP BY job) SELECT job, round(any_value(base), 6) AS base, min(n) AS \"at\" FROM r JOIN b USING (job) WHERE audio_ms < 0.75 * base GROUP BY job")
def anomaly_first_drop(spark, d):
    w = W.partitionBy("job")
    r = D.chunk_stats(spark, d).withColumn("i", F.row_number().over(w.orderBy("n"))).withColumn("c", F.count("*").over(w))
    base = r.where(F.col("i") <= F.floor(F.col("c") / 2)).groupBy("job").agg(F.median("audio_ms").alias("base"))
    return r.join(base, "job").where(F.col("audio_ms") < 0.75 * F.col("base")).groupBy("job").agg(F.round(F.first("base"), 6).alias("base"), F.min("n").alias("at"))


@query("rms_dbfs", _FR + "SELECT clip_id, round(20 * log10(sqrt(sum(amp::DOUBLE * amp) / count(*)) / 32768.0), 6) AS dbfs FROM frame GROUP BY clip_id")
def rms_dbfs(spark, d):
    return G.levels(D.frames(spark, d)).select("clip_id", F.round("dbfs", 6).alias("dbfs"))


@query("clip_ratio", _FR + "SELECT clip_id, round(count(*) FILTER (amp >= 32767 OR amp <= -32768) / count(*), 9)::DOUBLE AS clip_ratio FROM frame GROUP BY clip_id")
def clip_ratio(spark, d):
    return G.levels(D.frames(spark, d)).select("clip_id", F.round("clip_ratio", 9).alias("clip_ratio"))


_SNR = """, p AS (SELECT clip_id, frame_idx, amp::DOUBLE * amp AS power FROM frame), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY power, frame_idx) AS r, count(*) OVER (PARTITION BY clip_id) AS m FROM p),
q AS (SELECT clip_id, max(m) AS m, greatest(avg(power) FILTER (r <= greatest(1, m // 10)), 1e-12) AS noise, greatest(avg(power) FILTER (r > m - greatest(1, m // 2)), 1e-12) AS loud FROM r GROUP BY clip_id)"""


def _power(spark, d):
    return D.frames(spark, d).select("clip_id", "frame_idx", (F.col("amp").cast("double") * F.col("amp")).alias("power"))


@query("snr", _FR + _SNR + " SELECT clip_id, round(CASE WHEN m < 10 THEN 30.0 ELSE 10 * log10(loud / noise) END, 6)::DOUBLE AS snr FROM q")
def snr(spark, d):
    return G.snr(_power(spark, d), "clip_id", "power").select("clip_id", F.round("snr", 6).alias("snr"))


@query("preflight", _FR + _SNR + """, l AS (SELECT clip_id, 20 * log10(sqrt(sum(amp::DOUBLE * amp) / count(*)) / 32768.0) AS dbfs, count(*) FILTER (amp >= 32767 OR amp <= -32768) / count(*) AS cr, count(*) AS n FROM frame GROUP BY clip_id),
j AS (SELECT *, 8000 + clip_id % 3 * 8000 AS rate, CASE WHEN q.m < 10 THEN 30.0 ELSE 10 * log10(loud / noise) END AS s FROM l JOIN q USING (clip_id))
SELECT clip_id, 'sample_rate' AS name, rate >= 16000 AS passed FROM j UNION ALL SELECT clip_id, 'duration', n / 10.0 BETWEEN 5 AND 30 FROM j UNION ALL SELECT clip_id, 'clipping', cr <= 0.0005 FROM j
UNION ALL SELECT clip_id, 'loudness', dbfs BETWEEN -35 AND -10 FROM j UNION ALL SELECT clip_id, 'snr', s >= 15 FROM j""")
def preflight(spark, d):
    j = G.levels(D.frames(spark, d)).join(G.snr(_power(spark, d), "clip_id", "power"), "clip_id").withColumn("rate", 8000 + F.col("clip_id") % 3 * 8000)
    one = lambda name, ok: F.struct(F.lit(name).alias("name"), ok.alias("passed"))
    checks = F.array(one("sample_rate", F.col("rate") >= G.MIN_RATE), one("duration", (F.col("n") / 10.0).between(G.MIN_S, G.MAX_S)), one("clipping", F.col("clip_ratio") <= G.MAX_CLIP), one("loudness", F.col("dbfs").between(G.MIN_DBFS, G.MAX_DBFS)), one("snr", F.col("snr") >= G.MIN_SNR))
    return j.select("clip_id", F.explode(checks).alias("c")).select("clip_id", "c.name", "c.passed")


@query("rms_stability", _FR + ", w AS (SELECT clip_id, frame_idx // 6 AS w, sqrt(avg(amp::DOUBLE * amp)) AS rms FROM frame GROUP BY ALL) SELECT clip_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(rms) END, 4)::DOUBLE AS rms_std FROM w GROUP BY clip_id")
def rms_stability(spark, d):
    a = F.col("amp").cast("double")
    w = D.frames(spark, d).groupBy("clip_id", F.floor(F.col("frame_idx") / 6).alias("w")).agg(F.sqrt(F.avg(a * a)).alias("rms"))
    return w.groupBy("clip_id").agg(F.round(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("rms")), 4).alias("rms_std"))


@query("format_homogeneity", _ST + ", f AS (SELECT job, n, 24000 + CASE WHEN n % 37 = 36 THEN 1000 ELSE 0 END AS rate FROM stats), r AS (SELECT job, arg_min(rate, n) AS want FROM f GROUP BY job) SELECT job, min(n) AS first_mismatch FROM f JOIN r USING (job) WHERE rate <> want GROUP BY job")
def format_homogeneity(spark, d):
    f = D.chunk_stats(spark, d).select("job", "n", (24000 + F.when(F.col("n") % 37 == 36, 1000).otherwise(0)).alias("rate"))
    want = F.first("rate").over(W.partitionBy("job").orderBy("n"))
    return G.first_breach(f.withColumn("want", want), "job", "n", F.col("rate") != F.col("want")).withColumnRenamed("at", "first_mismatch")


@query("benchmark_stats", "SELECT l_returnflag AS config, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, round(avg(CASE WHEN l_discount > 0.02 THEN 1 ELSE 0 END), 6) AS pass_rate FROM lineitem GROUP BY 1")
def benchmark_stats(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("config")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"), F.round(F.avg(F.when(F.col("l_discount") > 0.02, 1).otherwise(0)), 6).alias("pass_rate"))


@query("downmix_mono", _FR + "SELECT clip_id, frame_idx // 2 AS i, floor(sum(amp) / 2)::BIGINT AS mono, round(avg(amp), 6) AS mean FROM frame GROUP BY ALL HAVING count(*) = 2")
def downmix_mono(spark, d):
    g = D.frames(spark, d).groupBy("clip_id", F.floor(F.col("frame_idx") / 2).alias("i")).agg(F.sum("amp").alias("s"), F.avg("amp").alias("mean"), F.count("*").alias("n"))
    return g.where("n = 2").select("clip_id", "i", F.floor(F.col("s") / 2).alias("mono"), F.round("mean", 6).alias("mean"))


@query("to_mono_float", _FR + """, k AS (SELECT clip_id, frame_idx, (['int16', 'int32', 'uint8', 'float'])[clip_id % 4 + 1] AS kind, amp::DOUBLE AS l, amp / 2.0::DOUBLE AS r FROM frame),
c AS (SELECT clip_id, frame_idx, kind, CASE kind WHEN 'int16' THEN (l + trunc(r)) / 2 WHEN 'int32' THEN (l * 65536 + trunc(r) * 65536) / 2 WHEN 'uint8' THEN (floor((l + 32768) / 256) + floor((r + 32768) / 256)) / 2 ELSE (l + r) / 2 / 16000 END AS m FROM k),
p AS (SELECT *, max(abs(m)) OVER (PARTITION BY clip_id) AS peak FROM c)
SELECT clip_id, frame_idx, round(CASE kind WHEN 'int16' THEN m / 32768.0 WHEN 'int32' THEN m / 2147483648.0 WHEN 'uint8' THEN (m - 128) / 127.0 WHEN 'float' THEN CASE WHEN peak > 1.001 THEN m / peak ELSE m END END, 9)::DOUBLE AS x FROM p""")
def to_mono_float(spark, d):
    left, k = F.col("amp").cast("double"), F.col("clip_id") % 4
    half = F.when(left / 2 < 0, F.ceil(left / 2)).otherwise(F.floor(left / 2)).cast("double")
    eight = lambda v: F.floor((v + 32768) / 256).cast("double")
    two = F.when(k == 0, F.array(left, half)).when(k == 1, F.array(left * 65536, half * 65536)).when(k == 2, F.array(eight(left), eight(left / 2))).otherwise(F.array(left / 16000, left / 2 / 16000))
    kind = F.element_at(F.array(*map(F.lit, ("int16", "int32", "uint8", "float"))), (k + 1).cast("int"))
    samples = D.frames(spark, d).select("clip_id", "frame_idx", kind.alias("kind"), two.alias("channels"))
    return G.mono_float(samples, "clip_id").select("clip_id", "frame_idx", F.round("x", 9).alias("x"))


@query("resample_linear", _FR + ", m AS (SELECT clip_id, count(*) AS n FROM frame GROUP BY 1), o AS (SELECT clip_id, n, unnest(range(n * 2 // 3)) AS j FROM m WHERE n > 2), p AS (SELECT *, j * (n - 1) / ((n * 2 // 3 - 1)::DOUBLE) AS x FROM o) SELECT p.clip_id, j, round(a.amp + (coalesce(b.amp, a.amp) - a.amp) * (x - floor(x)), 4) AS y FROM p JOIN frame a ON a.clip_id = p.clip_id AND a.frame_idx = floor(x)::BIGINT LEFT JOIN frame b ON b.clip_id = p.clip_id AND b.frame_idx = floor(x)::BIGINT + 1")
def resample_linear(spark, d):
    f = D.frames(spark, d)
    n = f.groupBy("clip_id").agg(F.count("*").alias("n")).where("n > 2").withColumn("k", F.floor(F.col("n") * 2 / 3))
    nxt = F.lead("amp").over(W.partitionBy("clip_id").orderBy("frame_idx"))
    o = n.select("clip_id", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")).withColumn("x", F.col("j") * (F.col("n") - 1) / (F.col("k") - 1)).withColumn("frame_idx", F.floor("x"))
    a = f.withColumn("next", F.coalesce(nxt, F.col("amp")))
    return o.join(a, ["clip_id", "frame_idx"]).select("clip_id", "j", F.round(F.col("amp") + (F.col("next") - F.col("amp")) * (F.col("x") - F.col("frame_idx")), 4).alias("y"))


_SP = f"WITH {D.SPEECH_SQL} "


@query("auto_trim", _SP + """, f AS (SELECT clip_id, i // 3 AS f, 10 * log10(greatest(avg(x * x), 1e-12)) AS db, count(*) AS n FROM speech GROUP BY ALL),
l AS (SELECT clip_id, sum(n)::BIGINT AS size, min(f) FILTER (db > -40 AND n = 3) AS a, max(f) FILTER (db > -40 AND n = 3) AS b FROM f GROUP BY clip_id)
SELECT clip_id, CASE WHEN size < 15 OR a IS NULL THEN 0 ELSE greatest(0, a - 3) * 3 END AS first, CASE WHEN size < 15 OR a IS NULL THEN size ELSE least(size, (b + 1 + 3) * 3) END AS "end" FROM l""")
def auto_trim(spark, d):
    return G.auto_trim(D.speech(spark, d), D.SPEECH_RATE)


@query("trim_chunk_silence", _SP + """, z AS (SELECT clip_id, count(*) AS size FROM speech GROUP BY 1), q AS (SELECT clip_id, i, size, 20 * log10(greatest(abs(x), 1e-6)) AS db FROM speech JOIN z USING (clip_id)),
l AS (SELECT clip_id, any_value(size) * 10 AS ms, coalesce(min(i) FILTER (db >= -45) * 10, any_value(size) * 10) AS lead, coalesce(min(size - 1 - i) FILTER (db >= -55) * 10, any_value(size) * 10) AS tail FROM q GROUP BY clip_id),
b AS (SELECT clip_id, ms, greatest(0, lead - 30) AS s, ms - greatest(0, tail - 100) AS e FROM l)
SELECT clip_id, CASE WHEN e <= s THEN 0 ELSE s END AS start_ms, CASE WHEN e <= s THEN ms ELSE e END AS end_ms FROM b""")
def trim_chunk_silence(spark, d):
    return G.trim_chunk_silence(D.speech(spark, d), D.SPEECH_RATE)


@query("detect_nonsilent", _SP + """, z AS (SELECT clip_id, count(*) * 10 AS ms FROM speech GROUP BY 1),
w AS (SELECT a.clip_id, a.i, 10 * log10(greatest(avg(b.x * b.x), 1e-12)) AS db, count(*) AS n FROM speech a JOIN speech b ON a.clip_id = b.clip_id AND b.i BETWEEN a.i AND a.i + 29 GROUP BY ALL),
ok AS (SELECT a.clip_id, a.i, NOT EXISTS (SELECT 1 FROM w WHERE w.clip_id = a.clip_id AND w.n = 30 AND w.db <= -40 AND a.i BETWEEN w.i AND w.i + 29) AS loud FROM speech a),
r AS (SELECT clip_id, i, i - row_number() OVER (PARTITION BY clip_id ORDER BY i) AS g FROM ok WHERE loud)
SELECT clip_id, min(i) * 10 AS start_ms, (max(i) + 1) * 10 AS end_ms FROM r GROUP BY clip_id, g""")
def detect_nonsilent(spark, d):
    return G.detect_nonsilent(D.speech(spark, d), D.SPEECH_RATE)


@query("emotion_slice_bounds", f"WITH {D.SEGMENTS_SQL}, z AS (SELECT source_id, (max(e_ms) - 9000) * 16 AS size FROM seg GROUP BY 1) SELECT seg_idx, least(s_ms * 16, size) AS a, least(e_ms * 16, size) AS b, least(e_ms * 16, size) - least(s_ms * 16, size) < 1600 AS too_short FROM seg JOIN z USING (source_id)")
def emotion_slice_bounds(spark, d):
    """Slices of clips that end before their last segments do."""
    s = D.segments(spark, d)
    size = s.groupBy("source_id").agg(((F.max("e_ms") - 9000) * 16).alias("size"))
    return G.slice_bounds(s.join(size, "source_id"), 16000).select("seg_idx", "a", "b", "too_short")


@query("lr_schedule", "SELECT p_partkey, round(CASE WHEN p_partkey < 100 THEN p_partkey / 100.0 ELSE greatest(0.0, 0.5 * (1 + cos(pi() * least(1.0, (p_partkey - 100) / 900.0)))) END, 6)::DOUBLE AS factor FROM part")
def lr_schedule(spark, d):
    s = F.col("p_partkey")
    cool = 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), (s - 100) / 900.0)))
    return table(spark, d, "part").select("p_partkey", F.round(F.when(s < 100, s / 100.0).otherwise(F.greatest(F.lit(0.0), cool)), 6).alias("factor"))


@query("early_stop", _ST + ", m AS (SELECT job, n, synth_ms, min(synth_ms) OVER (PARTITION BY job ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM stats), b AS (SELECT *, max(CASE WHEN best IS NULL OR synth_ms < best THEN n END) OVER (PARTITION BY job ORDER BY n ROWS UNBOUNDED PRECEDING) AS best_n FROM m) SELECT job, min(n) AS stop_n FROM b WHERE n - best_n >= 5 GROUP BY job")
def early_stop(spark, d):
    o = W.partitionBy("job").orderBy("n")
    best = F.min("synth_ms").over(o.rowsBetween(W.unboundedPreceding, -1))
    t = D.chunk_stats(spark, d).withColumn("best", best)
    t = t.withColumn("best_n", F.max(F.when(F.col("best").isNull() | (F.col("synth_ms") < F.col("best")), F.col("n"))).over(o.rowsBetween(W.unboundedPreceding, 0)))
    return t.where(F.col("n") - F.col("best_n") >= 5).groupBy("job").agg(F.min("n").alias("stop_n"))


@query("overall_progress", "SELECT l_orderkey, l_linenumber, l_linenumber * 100 + l_quantity::BIGINT * 100 // greatest(60, 1) AS progress FROM lineitem")
def overall_progress(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 100 + F.floor(F.col("l_quantity").cast("long") * 100 / F.lit(60))).alias("progress"))


@query("eta_from_ratio", "SELECT event_id, CASE WHEN event_id % 100 > 0 THEN round(event_id % 5000 * (1 - event_id % 100 / 100.0) / (event_id % 100 / 100.0), 6) END::DOUBLE AS eta FROM events")
def eta_from_ratio(spark, d):
    r = F.col("event_id") % 100 / 100.0
    return table(spark, d, "events").select("event_id", F.when(r > 0, F.round(F.try_divide(F.col("event_id") % 5000 * (1 - r), r), 6)).alias("eta"))


@query("parallel_eta", "SELECT event_id, round((1000 - event_id % 1000) / greatest(event_id % 1000 / greatest(event_id % 77, 0.1), 0.01), 6)::DOUBLE AS eta FROM events")
def parallel_eta(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round((1000 - e % 1000) / F.greatest(e % 1000 / F.greatest((e % 77).cast("double"), F.lit(0.1)), F.lit(0.01)), 6).alias("eta"))


@query("chunk_cap", r"""SELECT doc_id, s.k - 1 AS k, s.t AS chunk FROM (SELECT doc_id, unnest(a[:5]) AS s FROM (SELECT doc_id, [struct_pack(k := i, t := x) for x, i in
  [y for y in string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) if trim(y) <> '']] AS a FROM documents))""")
def chunk_cap(spark, d):
    """At most five chunks of each chapter."""
    from weftline.operators.text import capped, simple_sentences

    c = table(spark, d, "documents").select("doc_id", F.posexplode(capped(simple_sentences(F.col("text")), 5)).alias("k", "chunk"))
    return c.select("doc_id", F.col("k").cast("long").alias("k"), "chunk")


@query("list_packs_sorted", "SELECT p_name, p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part")
def list_packs_sorted(spark, d):
    return placed(table(spark, d, "part").select("p_name", "p_partkey"), F.lower("p_name"), "p_partkey")


@query("longest_first", "SELECT n_name, row_number() OVER (ORDER BY length(n_name) DESC, n_name) AS place FROM nation")
def longest_first(spark, d):
    return table(spark, d, "nation").select("n_name", F.row_number().over(W.orderBy(F.desc(F.length("n_name")), "n_name")).alias("place"))
