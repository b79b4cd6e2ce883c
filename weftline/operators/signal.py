"""Statistics of frames and of synthesis runs: exact, as grouped sums and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: preflight limits (Hz, s, s, dB, dBFS, dBFS, share)
MIN_RATE, MIN_S, MAX_S, MIN_SNR, MIN_DBFS, MAX_DBFS, MAX_CLIP = 16000, 5, 30, 15.0, -35.0, -10.0, 0.0005
FULL_SCALE, FLOOR_DB, SHORT_SNR = 32768.0, -100.0, 30.0


def loudness(sum_squares: Column, n: Column) -> Column:
    """RMS in dB of full scale; silence and nothing are at the floor."""
    rms = F.sqrt(F.try_divide(sum_squares, n))
    return F.when(F.coalesce(rms, F.lit(0.0)) <= 0, FLOOR_DB).otherwise(20 * F.log10(rms / FULL_SCALE))


def levels(samples: DataFrame, key: str = "clip_id", amp: str = "amp") -> DataFrame:
    """Loudness and share of samples at the rails, in one aggregation."""
    a = F.col(amp).cast("double")
    rail = F.count(F.when((F.col(amp) >= 32767) | (F.col(amp) <= -32768), 1))
    return samples.groupBy(key).agg(loudness(F.sum(a * a), F.count("*")).alias("dbfs"), (rail / F.count("*")).alias("clip_ratio"), F.count("*").alias("n"))


def snr(frames: DataFrame, key: str, power: str, loud_share: float = 0.5) -> DataFrame:
    """Ratio of the loudest ``loud_share`` of frames to the quietest tenth, in dB; 30 for fewer than ten frames."""
    w = W.partitionBy(key)
    r = frames.withColumn("r", F.row_number().over(w.orderBy(power, "frame_idx"))).withColumn("m", F.count("*").over(w))
    low, high = F.greatest(F.lit(1), F.floor(F.col("m") / 10)), F.greatest(F.lit(1), F.floor(F.col("m") * loud_share))
    mean = lambda cond: F.greatest(F.avg(F.when(cond, F.col(power))), F.lit(1e-12))
    g = r.groupBy(key).agg(mean(F.col("r") <= low).alias("noise"), mean(F.col("r") > F.col("m") - high).alias("loud"), F.max("m").alias("m"))
    return g.select(key, F.when(F.col("m") < 10, SHORT_SNR).otherwise(10 * F.log10(F.col("loud") / F.col("noise"))).alias("snr"))


def quarter_trend(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Means of the first and the last quarter (one row at least) and their difference."""
    w = W.partitionBy(key)
    r = rows.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(order))).withColumn("size", F.count("*").over(w))
    q = F.greatest(F.lit(1), F.floor(F.col("size") / 4))
    g = r.groupBy(key).agg(F.avg(F.when(F.col("i") <= q, F.col(value))).alias("first"), F.avg(F.when(F.col("i") > F.col("size") - q, F.col(value))).alias("last"))
    return g.withColumn("delta", F.col("last") - F.col("first"))


def first_breach(rows: DataFrame, key: str, order: str, bad: Column) -> DataFrame:
    """The first row of each key that is bad: (key, order)."""
    return rows.where(bad).groupBy(key).agg(F.min(order).alias("at"))


def runs(frames: DataFrame, key: str, order: str, loud: Column, gap: int) -> DataFrame:
    """Runs of loud frames; quiet stretches shorter than ``gap`` frames don't end one."""
    t = frames.where(loud)
    w = W.partitionBy(key).orderBy(order)
    t = t.withColumn("cut", F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)).withColumn("run", F.sum("cut").over(w))
    return t.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("run")


# fixed values: frames (ms) and thresholds (dB of full scale) of trimming and of silence, what is kept around speech (ms)
FRAME_MS, TRIM_DB, TRIM_PAD_MS, LEAST_FRAMES = 30, -40.0, 100, 5
STEP_MS, LEAD_DB, LEAD_KEEP_MS, TAIL_DB, TAIL_KEEP_MS = 10, -45.0, 30, -55.0, 100
SILENCE_DB, SILENCE_MS = -40.0, 300
#: Powers below this are taken for it.
LEAST_POWER = 1e-12


def mono_float(samples: DataFrame, key: str, kind: str = "kind", channels: str = "channels", out: str = "x") -> DataFrame:
    """Samples (``channels``, an array) as their mean in [-1, 1]. ``kind`` is the format: signed integers (int16, int32) by their full scale,
    uint8 around its middle, floats as they are unless a clip's peak (of the mean) is above 1.001, which then becomes 1."""
    mean = F.aggregate(channels, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(channels)
    t = samples.withColumn(out, mean)
    peaks = t.groupBy(key).agg(F.max(F.when(F.col(kind) == "float", F.abs(F.col(out)))).alias("peak of it"))
    t = t.join(peaks, key)
    peak, x, of = F.col("`peak of it`"), F.col(out), F.col(kind)
    scaled = F.when(of == "int16", x / 32768.0).when(of == "int32", x / 2147483648.0).when(of == "uint8", (x - 128.0) / 127.0).when(peak > 1.001, x / peak).otherwise(x)
    return t.withColumn(out, scaled).drop("peak of it")


def decibels(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(LEAST_POWER)))


def frame_powers(samples: DataFrame, length: int, key: str = "clip_id", order: str = "i", amp: str = "x") -> DataFrame:
    """Mean power of frames of ``length`` samples (numbered from 0, in [-1, 1]): key, f, power, n (samples of it)."""
    x = F.col(amp).cast("double")
    return samples.groupBy(key, F.floor(F.col(order) / length).alias("f")).agg(F.avg(x * x).alias("power"), F.count("*").alias("n"))


def auto_trim(samples: DataFrame, rate: int, *, key: str = "clip_id", threshold: float = TRIM_DB, frame_ms: int = FRAME_MS, pad_ms: int = TRIM_PAD_MS) -> DataFrame:
    """What is left of clips without silence at both ends: key, first (sample), end (the sample after the last). Whole frames louder than
    ``threshold`` and a pad around them stay; a clip of fewer than five frames or without a loud one stays whole."""
    length = max(1, rate * frame_ms // 1000)
    pad = max(1, rate * pad_ms // 1000 // length)
    loud = F.when((F.col("n") == length) & (decibels(F.col("power")) > threshold), F.col("f"))
    g = frame_powers(samples, length, key).groupBy(key).agg(F.sum("n").alias("size"), F.min(loud).alias("a"), F.max(loud).alias("b"))
    whole = F.col("a").isNull() | (F.col("size") < LEAST_FRAMES * length)
    first = F.greatest(F.lit(0), F.col("a") - pad) * length
    end = F.least(F.col("size"), (F.col("b") + 1 + pad) * length)
    return g.select(key, F.when(whole, 0).otherwise(first).cast("long").alias("first"), F.when(whole, F.col("size")).otherwise(end).cast("long").alias("end"))


def trim_chunk_silence(samples: DataFrame, rate: int, *, key: str = "clip_id", lead_db: float = LEAD_DB, keep_ms: int = LEAD_KEEP_MS, tail_db: float = TAIL_DB, tail_keep_ms: int = TAIL_KEEP_MS) -> DataFrame:
    """Bounds (ms) of synthesized chunks without dead air: key, start_ms, end_ms. Both ends are walked in steps of 10 ms, the tail with a lower
    threshold, so that quiet endings stay; an all silent chunk stays whole."""
    step = max(1, rate * STEP_MS // 1000)
    sizes = samples.groupBy(key).agg((F.max("i") + 1).alias("size"))
    back = samples.join(sizes, key).select(key, (F.col("size") - 1 - F.col("i")).alias("i"), "x")
    loud = lambda rows, db, name: frame_powers(rows, step, key).where(decibels(F.col("power")) >= db).groupBy(key).agg((F.min("f") * STEP_MS).alias(name))
    g = sizes.join(loud(samples, lead_db, "lead"), key, "left").join(loud(back, tail_db, "tail"), key, "left")
    ms = F.floor(F.col("size") * 1000 / rate)
    start = F.greatest(F.lit(0), F.coalesce("lead", ms) - keep_ms)
    end = ms - F.greatest(F.lit(0), F.coalesce("tail", ms) - tail_keep_ms)
    return g.select(key, F.when(end <= start, 0).otherwise(start).cast("long").alias("start_ms"), F.when(end <= start, ms).otherwise(end).cast("long").alias("end_ms"))


def detect_nonsilent(samples: DataFrame, rate: int, *, key: str = "clip_id", threshold: float = SILENCE_DB, least_ms: int = SILENCE_MS) -> DataFrame:
    """What lies between silences (ms): key, start_ms, end_ms. A stretch of ``least_ms``, at steps of 10 ms, is silent if its power as a whole is
    at most ``threshold``; silent stretches that meet are one. Clips that are silent all along have no row."""
    step = max(1, rate * STEP_MS // 1000)
    k = least_ms // STEP_MS
    c = samples.groupBy(key, F.floor(F.col("i") / step).alias("f")).agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("s"), F.count("*").alias("n"))
    ends = samples.groupBy(key).agg(F.floor((F.max("i") + 1) * 1000 / rate).alias("ms"))
    by = W.partitionBy(key).orderBy("f")
    ahead = by.rowsBetween(0, k - 1)
    windows = c.withColumn("power", F.sum("s").over(ahead) / F.sum("n").over(ahead)).withColumn("whole", F.sum((F.col("n") == step).cast("int")).over(ahead) == k)
    quiet = windows.where(F.col("whole") & (decibels(F.col("power")) <= threshold))
    quiet = quiet.withColumn("cut", F.when(F.col("f") - F.lag("f").over(by) <= k, 0).otherwise(1)).withColumn("run", F.sum("cut").over(by))
    quiet = quiet.groupBy(key, "run").agg((F.min("f") * STEP_MS).alias("a"), (F.max("f") * STEP_MS + least_ms).alias("b"))
    # speech lies from the end of each silence, or the beginning, to the next one, or the end
    edges = quiet.select(key, "a", "b").unionByName(ends.select(key, F.lit(None).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    after = F.lead("a").over(W.partitionBy(key).orderBy(F.col("a").asc_nulls_first()))
    spans = edges.withColumn("next", after).join(ends, key)
    return spans.select(key, F.col("b").cast("long").alias("start_ms"), F.least(F.coalesce("next", "ms"), F.col("ms")).cast("long").alias("end_ms")).where("end_ms > start_ms")


def slice_bounds(spans: DataFrame, rate: int, size: str = "size", least_ms: int = 100) -> DataFrame:
    """Samples [a, b) of (s_ms, e_ms) within a clip of ``size`` samples; slices shorter than ``least_ms`` are marked."""
    a = F.least(F.col("s_ms") * rate / 1000, F.col(size)).cast("long")
    b = F.least(F.col("e_ms") * rate / 1000, F.col(size)).cast("long")
    return spans.withColumn("a", a).withColumn("b", b).withColumn("too_short", F.col("b") - F.col("a") < rate * least_ms / 1000)
