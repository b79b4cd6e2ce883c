"""Speech records, manifests, summaries and settings as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "start double, end double, text string, speaker string, confidence double, character string"
MANIFEST = "speaker string, root_dir string, clips array<struct<path:string,text:string,emotion:string,speaker:string,duration:double>>, total_seconds double, emotion_counts map<string,int>, sample_rate_hz int"
SUMMARY_KEYS = ("speaker", "total_seconds", "chunk_count", "mean_chunk_seconds", "quality_tier")
#: Tiers that a pack can have, its format's version.
PACK_TIERS, PACK_VERSION = ("full_lora", "reduced_lora", "few_shot"), 1


def read_transcripts(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """JSON lines of chunks. Strict: a broken line fails the read. Else such lines are left in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(TRANSCRIPT).option("mode", "FAILFAST").json(path)
    return spark.read.schema(TRANSCRIPT + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def write_transcripts(chunks: DataFrame, path: str) -> None:
    """JSON lines with null characters written out; the commit protocol leaves whole files only."""
    chunks.select(*[c.split()[0] for c in TRANSCRIPT.split(", ")]).write.option("ignoreNullFields", "false").json(path)


def read_manifests(spark: SparkSession, path: str, *, multiline: bool = False) -> DataFrame:
    """Manifests, a JSON value a line or (``multiline``) a file each, as one row a clip."""
    m = spark.read.schema(MANIFEST).option("multiLine", str(multiline).lower()).json(path)
    return m.select(F.col("speaker").alias("dataset"), "sample_rate_hz", F.explode("clips").alias("c")).select("dataset", "sample_rate_hz", "c.*")


def write_summaries(summaries: DataFrame, path: str, *, most: int = 100_000) -> str:
    """Speakers as YAML, the largest first; a report that a person reads, made on the driver: more than ``most`` rows are an error, none is left out."""
    import yaml

    rows = summaries.select(*SUMMARY_KEYS).orderBy(F.desc("total_seconds"), "speaker").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} speakers; write them as a table")
    text = yaml.safe_dump([r.asDict() for r in rows], allow_unicode=True, sort_keys=False)
    write_whole(path, text)
    return text


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows = [tuple(x[k] for k in SUMMARY_KEYS) for x in yaml.safe_load(text) or []]
    return spark.createDataFrame(rows, "speaker string, total_seconds double, chunk_count long, mean_chunk_seconds double, quality_tier string")


def write_whole(path: str, text: str) -> None:
    """A file that is either whole or absent: written beside its place and then moved."""
    import uuid

    import pyarrow.fs as pafs

    fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(text.encode())
    fs.move(part, at)


def ljspeech_lines(clips: DataFrame) -> DataFrame:
    """path|text|emotion|seconds; bars in texts stay."""
    return clips.select(F.concat_ws("|", F.regexp_replace("path", r"\.wav$", ""), "text", "emotion", F.format_string("%.3f", F.col("duration"))).alias("value"))


def report_rows(summaries: DataFrame) -> DataFrame:
    """Markdown rows of the summary table, the largest speaker first."""
    from pyspark.sql import Window as W

    row = F.format_string("| %s | %.1f | %d | %.2f | %s |", "speaker", F.col("total_seconds") / 60, "chunk_count", "mean_chunk_seconds", "quality_tier")
    return summaries.select(F.row_number().over(W.orderBy(F.desc("total_seconds"), "speaker")).alias("place"), row.alias("row"))


def read_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Settings files by a fixed schema: other keys and values of other kinds are dropped."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("s")).select("s.*")


def pack_issues(packs: DataFrame) -> DataFrame:
    """All that is wrong with packs of (pack, name, tier, format_version, files array, and error if it is there): an empty array is a valid pack."""
    lacks = lambda f: ~F.array_contains("files", f)
    tier = F.col("tier")
    error = F.col("error") if "error" in packs.columns else F.lit(None).cast("string")
    meta = lacks("meta.yaml") | error.isNotNull()
    checks = [
        F.when(lacks("meta.yaml"), "meta.yaml missing"),
        error,
        F.when(~meta & F.col("name").isNull(), "meta.yaml missing required key: name"),
        F.when(~meta & ~tier.isin(*PACK_TIERS), F.concat(F.lit("unknown tier "), tier)),
        F.when(~meta & (F.col("format_version") > PACK_VERSION), F.concat(F.lit("format version "), F.col("format_version").cast("string"), F.lit(" is newer than supported"))),
        F.when(lacks("sample.wav"), "sample.wav missing"),
        F.when(~meta & tier.isin("full_lora", "reduced_lora") & lacks("adapter.pt"), F.concat(F.lit("adapter.pt missing for tier="), tier)),
        F.when(~meta & (tier == "few_shot") & lacks("reference.wav"), "reference.wav missing for tier=few_shot"),
    ]
    return packs.select("pack", "name", F.array_compact(F.array(*checks)).alias("issues"))


def read_packs(spark: SparkSession, root: str) -> DataFrame:
    """Pack folders below ``root``, as ``pack_issues`` takes them: pack, name, tier, format_version, files, error (of a meta.yaml that isn't a mapping or
    can't be parsed). File names come from a listing; only the meta files are read."""
    import yaml

    def parse(batches):
        import pandas as pd

        for b in batches:
            out = []
            for pack, content in zip(b["pack"], b["content"], strict=True):
                error, m = None, {}
                try:
                    m = yaml.safe_load(bytes(content).decode())
                    if not isinstance(m, dict):
                        error, m = "meta.yaml is not a mapping", {}
                    version = int(m.get("format_version", PACK_VERSION))
                except (yaml.YAMLError, UnicodeDecodeError) as e:
                    error, m, version = f"meta.yaml parse error: {type(e).__name__}", {}, PACK_VERSION
                except (TypeError, ValueError):
                    error, version = "meta.yaml has bad value: format_version", PACK_VERSION
                out.append((pack, m.get("name"), m.get("tier"), version, error))
            yield pd.DataFrame(out, columns=["pack", "name", "tier", "format_version", "error"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = F.split("path", "/")
    found = found.withColumn("pack", F.element_at(part, -2)).withColumn("file", F.element_at(part, -1))
    files = found.groupBy("pack").agg(F.array_sort(F.collect_set("file")).alias("files"))
    meta = found.where("file = 'meta.yaml'").select("pack", "content").mapInPandas(parse, "pack string, name string, tier string, format_version int, error string")
    return files.join(meta, "pack", "left").select("pack", "name", "tier", "format_version", "files", "error")


def list_packs(packs: DataFrame) -> DataFrame:
    """Valid packs in the order of their names in lower case: pack, name, place."""
    from weftline.operators.ranking import placed

    issues = pack_issues(packs).where(F.size("issues") == 0)
    return placed(issues.select("pack", "name", F.xxhash64("pack").alias("id of it")), F.concat(F.lower("name"), F.lit("\x00"), F.col("pack")), "id of it").select("pack", "name", "place")


def write_packs(packs: DataFrame, root: str) -> DataFrame:
    """Pack folders of (pack, file, content string): each file whole or absent. Returns pack and its number of files."""

    def put(batches):
        import pandas as pd

        for b in batches:
            for pack, file, content in zip(b["pack"], b["file"], b["content"], strict=True):
                write_whole(f"{root}/{pack}/{file}", content)
            yield pd.DataFrame({"pack": b["pack"]})

    return packs.select("pack", "file", "content").mapInPandas(put, "pack string").groupBy("pack").agg(F.count("*").alias("files"))


def folder_size(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes below a folder, from its listing; what Spark's writers leave beside the data doesn't count."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return found.where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]")).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def audio_plan(chunks: DataFrame, *, gap_ms: int = 250) -> DataFrame:
    """The list of an assembly in order: each chunk but the last of its job is followed by a gap."""
    from pyspark.sql import Window as W

    w = W.partitionBy("job").orderBy("n")
    t = chunks.withColumn("last", F.lead("n").over(w).isNull()).withColumn("i", F.row_number().over(w))
    item = lambda k, ms, place: F.struct(F.lit(k).alias("kind"), ms.cast("long").alias("ms"), place.cast("long").alias("place"))
    sound = item("chunk", F.col("audio_ms"), F.col("i") * 2 - 2)
    return t.select("job", F.explode(F.when(F.col("last"), F.array(sound)).otherwise(F.array(sound, item("gap", F.lit(gap_ms), F.col("i") * 2 - 1)))).alias("x")).select("job", "x.*")


def next_free(paths: DataFrame) -> DataFrame:
    """For each (path, taken boolean): the path itself if it is free, else the next number of its stem that isn't taken."""
    stem, suffix = F.regexp_extract("path", r"^(.*?)(?:_(\d+))?(\.[^./]+)$", 1), F.regexp_extract("path", r"(\.[^./]+)$", 1)
    no = F.coalesce(F.regexp_extract("path", r"_(\d+)\.[^./]+$", 1).try_cast("int"), F.lit(1))
    t = paths.withColumn("stem", stem).withColumn("suffix", suffix).withColumn("no", no)
    used = t.where("taken").groupBy("stem", "suffix").agg(F.array_sort(F.collect_set("no")).alias("used"))
    t = t.join(used, ["stem", "suffix"], "left")
    # among as many numbers after it as are used, plus one, one is free
    free = F.array_min(F.array_except(F.sequence(F.col("no") + 1, F.col("no") + F.size("used") + 1), F.col("used")))
    return t.select("path", F.when(~F.col("taken"), F.col("path")).otherwise(F.concat("stem", F.lit("_"), free.cast("string"), "suffix")).alias("free"))
