"""Queries of sources and sinks (written, then read back) and of the smaller scalar operators."""

from __future__ import annotations

import io
import wave
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import scalars as S
from weftline.operators import speech as P
from weftline.operators.text import mapped
from weftline.plans import cleaning_sql as Q
from weftline.plans.logs import _folder
from weftline.plans.registry import query
from weftline.plans.speech import _GOOD, _JOINED, _TIER, _chunks
from weftline.session import spread, table
from weftline.sources import books as B
from weftline.sources import derived as D
from weftline.sources import records as R

C, L = F.col, F.lit


def _s(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _transcripts(spark, d):
    return _chunks(spark, d).select((C("s_ms") / 1000).alias("start"), (C("e_ms") / 1000).alias("end"), "text", "speaker", "confidence", L(None).cast("string").alias("character"))


_TR = "SELECT s_ms / 1000 AS start, e_ms / 1000 AS \"end\", text, speaker, confidence FROM chunk"


@query("src_transcripts_jsonl", f"WITH {_JOINED} {_TR}")
def src_transcripts_jsonl(spark, d):
    path = _folder(spark)
    R.write_transcripts(_transcripts(spark, d), path)
    return R.read_transcripts(spark, path).drop("character")


@query("sink_transcripts_jsonl", f"WITH {_JOINED} SELECT count(*) AS lines, count(*) AS with_null_character FROM chunk")
def sink_transcripts_jsonl(spark, d):
    path = _folder(spark)
    R.write_transcripts(_transcripts(spark, d), path)
    return spark.read.text(path).agg(F.count("*").alias("lines"), F.count(F.when(C("value").contains('"character":null'), 1)).alias("with_null_character"))


@query("src_manifest_json", f"WITH {D.TAGGED_SQL} SELECT speaker AS dataset, 24000 AS sample_rate_hz, 'clips/' || clip_id || '.wav' AS path, emotion, ms / 1000 AS duration FROM tagged")
def src_manifest_json(spark, d):
    t = D.tagged(spark, d).withColumn("c", F.struct(F.concat(L("clips/"), _s("clip_id"), L(".wav")).alias("path"), L("x").alias("text"), "emotion", "speaker", (C("ms") / 1000).alias("duration")))
    m = t.groupBy("speaker", F.pmod(C("clip_id"), L(8)).alias("part")).agg(F.collect_list("c").alias("clips"), (F.sum("ms") / 1000).alias("total_seconds"))
    path = _folder(spark)
    m.select("speaker", L("root").alias("root_dir"), "clips", "total_seconds", L(24000).alias("sample_rate_hz")).write.json(path)
    return R.read_manifests(spark, path).select("dataset", "sample_rate_hz", "path", "emotion", "duration")


_SUMMARY = f"WITH {_GOOD}, s AS (SELECT speaker, sum(e_ms - s_ms)::BIGINT AS ms, count(*) AS n FROM good GROUP BY ALL) "


def _summaries(spark, d):
    return P.summarize_speakers(P.quality_filter(_chunks(spark, d)), "speaker")


@query("src_speakers_yaml", _SUMMARY + f"SELECT speaker, ms / 1000 AS total_seconds, n AS chunk_count, {_TIER.format('(ms / 1000)')} AS quality_tier FROM s")
def src_speakers_yaml(spark, d):
    path = _folder(spark) + "/speakers.yaml"
    R.write_summaries(_summaries(spark, d), path)
    return R.read_summaries(spark, path).select("speaker", "total_seconds", "chunk_count", "quality_tier")


@query("sink_speakers_yaml", _SUMMARY + "SELECT row_number() OVER (ORDER BY ms DESC, speaker) AS place, speaker FROM s")
def sink_speakers_yaml(spark, d):
    import yaml

    text = R.write_summaries(_summaries(spark, d), _folder(spark) + "/speakers.yaml")
    return spark.createDataFrame([(i + 1, x["speaker"]) for i, x in enumerate(yaml.safe_load(text))], "place long, speaker string")


_REPORT = _SUMMARY + f"SELECT row_number() OVER (ORDER BY ms DESC, speaker) AS place, format('| {{}} | {{:.1f}} | {{}} | {{:.2f}} | {{}} |', speaker, ms / 60000, n, round(ms / 1000 / n, 6), {_TIER.format('(ms / 1000)')}) AS row FROM s"


@query("sink_report_md", _REPORT)
def sink_report_md(spark, d):
    return R.report_rows(_summaries(spark, d))


@query("report_tables", _REPORT)
def report_tables(spark, d):
    path = _folder(spark)
    rows = R.report_rows(_summaries(spark, d))
    rows.write.parquet(path)
    return spark.read.parquet(path)


@query("sink_ljspeech", f"WITH {D.TAGGED_SQL} SELECT format('clips/{{}}|{{}}|{{}}|{{:.3f}}', clip_id, 'a|b ' || speaker, emotion, ms / 1000) AS value FROM tagged")
def sink_ljspeech(spark, d):
    clips = D.tagged(spark, d).select(F.concat(L("clips/"), _s("clip_id"), L(".wav")).alias("path"), F.concat(L("a|b "), "speaker").alias("text"), "emotion", (C("ms") / 1000).alias("duration"))
    path = _folder(spark)
    R.ljspeech_lines(clips).write.text(path)
    return spark.read.text(path)


@query("sink_csv", f"WITH {D.STATS_SQL} SELECT job, count(*) AS n, sum(audio_ms)::BIGINT AS ms FROM stats GROUP BY job")
def sink_csv(spark, d):
    path = _folder(spark)
    D.chunk_stats(spark, d).groupBy("job").agg(F.count("*").alias("n"), F.sum("audio_ms").alias("ms")).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="job long, n long, ms long")


@query("sink_stats_append", f"WITH {D.STATS_SQL} SELECT job, n, audio_ms FROM stats")
def sink_stats_append(spark, d):
    path = _folder(spark)
    s = D.chunk_stats(spark, d).select("job", "n", "audio_ms")
    s.where("n % 2 = 0").write.mode("append").json(path)
    s.where("n % 2 = 1").write.mode("append").json(path)
    return spark.read.schema("job long, n long, audio_ms long").json(path)


@query("sink_atomic_json", f"WITH {D.STATS_SQL} SELECT count(*) AS chunks, sum(audio_ms)::BIGINT AS audio_ms FROM stats")
def sink_atomic_json(spark, d):
    path = _folder(spark) + "/progress.json"
    row = D.chunk_stats(spark, d).agg(F.count("*").alias("chunks"), F.sum("audio_ms").alias("audio_ms"))
    R.write_whole(path, row.toJSON().first())
    return spark.read.schema("chunks long, audio_ms long").json(path)


@query("sink_audio", f"WITH {D.STATS_SQL}, r AS (SELECT job, audio_ms, row_number() OVER (PARTITION BY job ORDER BY n) AS i, count(*) OVER (PARTITION BY job) AS c FROM stats) SELECT job, 'chunk' AS kind, audio_ms AS ms, i * 2 - 2 AS place FROM r UNION ALL SELECT job, 'gap', 250, i * 2 - 1 FROM r WHERE i < c")
def sink_audio(spark, d):
    return R.audio_plan(D.chunk_stats(spark, d))


@query("sink_path_next", "WITH p AS (SELECT p_partkey, 'book' || p_partkey // 9 || CASE WHEN p_partkey % 9 > 1 THEN '_' || p_partkey % 9 ELSE '' END || '.mp3' AS path, p_partkey % 9 IN (0, 2, 3, 5) AS taken FROM part WHERE p_partkey % 9 <> 1) SELECT path, CASE WHEN NOT taken THEN path ELSE 'book' || p_partkey // 9 || CASE p_partkey % 9 WHEN 0 THEN CASE WHEN EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey + 2) THEN CASE WHEN EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey + 3) THEN '_4' ELSE '_3' END ELSE '_2' END WHEN 2 THEN CASE WHEN EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey + 1) THEN '_4' ELSE '_3' END WHEN 3 THEN '_4' ELSE '_6' END || '.mp3' END AS free FROM p")
def sink_path_next(spark, d):
    k = C("p_partkey")
    no = k % 9
    path = F.concat(L("book"), _s(F.floor(k / 9)), F.when(no > 1, F.concat(L("_"), _s(no))).otherwise(""), L(".mp3"))
    return R.next_free(table(spark, d, "part").where(no != 1).select(path.alias("path"), no.isin(0, 2, 3, 5).alias("taken")))


@query("slugify", r"SELECT p_partkey, trim(regexp_replace(lower(p_name || ' #' || p_size || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", S.slug(F.concat("p_name", L(" #"), _s("p_size"), L("!"))).alias("slug"))


@query("src_txt", "SELECT s_suppkey, s_name || chr(10) || 'äö ' || s_nationkey || chr(10) AS content FROM supplier")
def src_txt(spark, d):
    """Texts written a file each and read as whole books by their ending."""
    path = _folder(spark)
    text = F.concat("s_name", L("\näö "), _s("s_nationkey"), L("\n"))
    R.write_packs(table(spark, d, "supplier").select(_s("s_suppkey").alias("pack"), L("book.txt").alias("file"), text.alias("content")), path).count()
    got = B.read_books(spark, f"{path}/*/book.txt")
    return got.select(F.element_at(F.split("path", "/"), -2).cast("long").alias("s_suppkey"), "content")


@query("html_to_text")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", B.html_text(C("html")).alias("text"))


def _epub(pages: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(pages)))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in reversed(range(1, len(pages))))
        z.writestr("OEBPS/b.opf", f"<package><manifest>{items}</manifest><spine>{spine}</spine></package>")
        for i, p in enumerate(pages):
            z.writestr(f"OEBPS/c{i}.xhtml", p)
    return out.getvalue()


@query("src_epub")
def src_epub(spark, d):
    """Books of five pages each, packed as EPUB and parsed again."""
    build = F.pandas_udf(lambda s: s.map(lambda p: _epub(list(p))), T.BinaryType())
    pages = table(spark, d, "pages").groupBy(F.floor(C("page_id") / 5).alias("book")).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("p"))
    files = pages.select(F.concat(L("book"), _s("book"), L(".epub")).alias("path"), build(F.transform("p", lambda x: x["html"])).alias("content"))
    return B.epub_chapters(files)


_PAGED = f"""l AS (SELECT doc_id, page, (page - 1) * 10 + k AS n, line FROM (SELECT doc_id, p AS page, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM
 (SELECT doc_id, i AS p, string_split(CASE WHEN i % 4 = 0 THEN 'Chapter ' || i || chr(10) ELSE '' END || x, chr(10)) AS ls FROM (SELECT doc_id, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)))
 WHERE {Q.stripped("array_to_string(ls, '')")} <> ''))"""


@query("src_pdf", f"""WITH {_PAGED}, {Q.CHAPTERS}, pg AS (SELECT doc_id, part, min(page) FILTER (h) AS a, max(page) AS z FROM p GROUP BY ALL),
e AS (SELECT doc_id, part, coalesce(a, 1) AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY part), max(z) OVER (PARTITION BY doc_id)) AS z FROM pg)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS idx, coalesce(title, 'Alkusanat') AS title, md5(content) AS digest, a AS page_start, z AS page_end FROM c JOIN e USING (doc_id, part)
UNION ALL SELECT doc_id, 0, 'Kirja', md5(content), 1, (SELECT max(page) FROM l WHERE l.doc_id = w.doc_id) FROM w""")
def src_pdf(spark, d):
    """Chapters of extracted pages: every document is a book with a page for each paragraph."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    no = C("page_no") + 1
    pages = docs.select("doc_id", no.alias("page_no"), F.concat(F.when(no % 4 == 0, F.concat(L("Chapter "), _s(no), L("\n"))).otherwise(""), "text").alias("text"))
    return B.pages_to_chapters(pages).select("doc_id", "idx", "title", F.md5(C("content").cast("binary")).alias("digest"), "page_start", "page_end")


@query("src_wav", f"WITH {D.FRAMES_SQL} SELECT clip_id::VARCHAR AS path, 16000::BIGINT AS rate, count(*) AS n, sum(amp)::BIGINT AS total FROM frame GROUP BY clip_id")
def src_wav(spark, d):
    def pack(samples) -> bytes:
        import numpy as np

        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(16000)
            w.writeframes(np.asarray(samples, dtype="<i2").tobytes())
        return out.getvalue()

    build = F.pandas_udf(lambda s: s.map(pack), T.BinaryType())
    clips = D.frames(spark, d).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "amp"))).alias("a"))
    files = clips.select(_s("clip_id").alias("path"), build(F.transform("a", lambda x: x["amp"])).alias("content"))
    return B.wav_samples(files).select("path", "rate", F.size("samples").cast("long").alias("n"), F.aggregate("samples", L(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("src_config", "SELECT s_suppkey, 'fi' AS language, s_suppkey % 2 = 0 AS dark FROM supplier")
def src_config(spark, d):
    path = _folder(spark)
    text = F.concat(L('{"language": "fi", "legacy": [1], "key": '), _s("s_suppkey"), L(', "dark": '), _s(C("s_suppkey") % 2 == 0), L("}"))
    R.write_packs(table(spark, d, "supplier").select(_s("s_suppkey").alias("pack"), L("settings.json").alias("file"), text.alias("content")), path).count()
    return R.read_settings(spark, f"{path}/*/settings.json", "key long, language string, dark boolean").select(C("key").alias("s_suppkey"), "language", "dark")


def _packs(spark, d):
    k = C("p_partkey")
    file = lambda n, m: F.when(k % m != 0, n)
    files = F.array_compact(F.array(file("meta.yaml", 11), file("sample.wav", 7), file("adapter.pt", 5), file("reference.wav", 3)))
    tier = F.element_at(F.array(*map(F.lit, ("full_lora", "few_shot", "gold"))), (k % 3 + 1).cast("int"))
    return table(spark, d, "part").select(_s(k).alias("pack"), "p_name", C("p_name").alias("name"), tier.alias("tier"), (1 + (k % 13 == 0).cast("int")).alias("format_version"), files.alias("files"))


_ISSUES = """SELECT p_partkey::VARCHAR AS pack, array_to_string([x for x in [CASE WHEN m THEN 'meta.yaml missing' END, CASE WHEN NOT m AND p_partkey % 3 = 2 THEN 'unknown tier gold' END,
  CASE WHEN NOT m AND p_partkey % 13 = 0 THEN 'format version 2 is newer than supported' END, CASE WHEN p_partkey % 7 = 0 THEN 'sample.wav missing' END,
  CASE WHEN NOT m AND p_partkey % 3 = 0 AND p_partkey % 5 = 0 THEN 'adapter.pt missing for tier=full_lora' END] if x is not null], '; ') AS issues FROM (SELECT *, p_partkey % 11 = 0 AS m FROM part)"""


@query("first_issue_list", _ISSUES)
def first_issue_list(spark, d):
    return R.pack_issues(_packs(spark, d)).select("pack", F.array_join("issues", "; ").alias("issues"))


_DIR_ISSUES = """SELECT s_suppkey::VARCHAR AS pack, 'N ' || s_name AS name, array_to_string([x for x in [CASE WHEN s_suppkey % 11 = 10 THEN 'meta.yaml missing' END, CASE WHEN s_suppkey % 11 = 9 THEN 'meta.yaml is not a mapping' END,
  CASE WHEN s_suppkey % 11 < 9 AND s_suppkey % 3 = 2 THEN 'unknown tier gold' END, CASE WHEN s_suppkey % 11 < 9 AND s_suppkey % 13 = 0 THEN 'format version 2 is newer than supported' END, CASE WHEN s_suppkey % 7 = 0 THEN 'sample.wav missing' END,
  CASE WHEN s_suppkey % 11 < 9 AND s_suppkey % 3 = 0 AND s_suppkey % 5 = 0 THEN 'adapter.pt missing for tier=full_lora' END] if x is not null], '; ') AS issues FROM supplier"""


def _pack_folder(spark, d):
    """A folder of packs, of which some lack files or have a bad meta.yaml."""
    root, k = _folder(spark), C("s_suppkey")
    tier = F.element_at(F.array(*map(F.lit, ("full_lora", "few_shot", "gold"))), (k % 3 + 1).cast("int"))
    meta = F.when(k % 11 == 9, L("- a list")).otherwise(F.concat(L("name: N "), "s_name", L("\ntier: "), tier, L("\nformat_version: "), _s(1 + (k % 13 == 0).cast("int"))))
    one = lambda name, there, content: F.when(there, F.struct(L(name).alias("file"), content.alias("content")))
    files = F.array_compact(F.array(one("meta.yaml", k % 11 != 10, meta), one("sample.wav", k % 7 != 0, L("x")), one("adapter.pt", k % 5 != 0, L("x")), one("reference.wav", k >= 0, L("x"))))
    rows = table(spark, d, "supplier").select(_s("s_suppkey").alias("pack"), F.explode(files).alias("f")).select("pack", "f.*")
    R.write_packs(rows, root).count()
    return root


@query("validate_pack_dir", f"SELECT pack, issues FROM ({_DIR_ISSUES})")
def validate_pack_dir(spark, d):
    return R.pack_issues(R.read_packs(spark, _pack_folder(spark, d))).select("pack", F.array_join("issues", "; ").alias("issues"))


@query("src_pack_dir", f"SELECT pack, name, row_number() OVER (ORDER BY lower(name), pack) AS place FROM ({_DIR_ISSUES}) WHERE issues = ''")
def src_pack_dir(spark, d):
    return R.list_packs(R.read_packs(spark, _pack_folder(spark, d)))


@query("dir_size", "SELECT count(*) AS files, sum(octet_length(encode(s_name || '!')))::BIGINT AS bytes FROM supplier")
def dir_size(spark, d):
    root = _folder(spark)
    R.write_packs(table(spark, d, "supplier").select(_s("s_suppkey").alias("pack"), L("f.txt").alias("file"), F.concat("s_name", L("!")).alias("content")), root).count()
    return R.folder_size(spark, root)


@query("sequence_ratio")
def sequence_ratio(spark, d):
    from difflib import SequenceMatcher

    ratio = mapped(lambda x: round(SequenceMatcher(None, *x.split("\x00", 1)).ratio(), 6), T.DoubleType())
    return table(spark, d, "nation").select("n_nationkey", ratio(F.concat(F.lower("n_name"), L("\x00"), F.lower(F.reverse("n_name")))).alias("ratio"))


@query("parse_kv_counts", "SELECT event_id, event_id % 50 AS angry, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 7 END AS sad, CASE WHEN event_id % 9 = 0 THEN 'sad=many' END AS bad FROM events")
def parse_kv_counts(spark, d):
    e = C("event_id")
    text = F.concat(L("angry = "), _s(e % 50), L(", ,sad="), F.when(e % 9 == 0, "many").otherwise(_s(e % 7)))
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    pairs = F.transform(tokens, lambda t: F.struct(F.trim(F.substring_index(t, "=", 1)).alias("k"), F.trim(F.substring_index(t, "=", -1)).try_cast("bigint").alias("v"), t.alias("t")))
    m = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))
    bad = F.try_element_at(F.filter(pairs, lambda p: p["v"].isNull() | (p["k"] == "")), L(1))["t"]
    return table(spark, d, "events").select("event_id", m["angry"].alias("angry"), m["sad"].alias("sad"), bad.alias("bad"))


@query("parse_gpu_csv", "SELECT s_suppkey, s_name AS gpu, '535.' || s_suppkey % 100 AS driver, (s_suppkey % 24)::INTEGER * 1024 AS vram_mb FROM supplier")
def parse_gpu_csv(spark, d):
    k = C("s_suppkey")
    out = F.concat("s_name", L(", 535."), _s(k % 100), L(", "), _s(k % 24 * 1024), L(".0\nOther, 1, 2"))
    row = F.from_csv(F.substring_index(out, "\n", 1), "gpu string, driver string, vram double", {"ignoreLeadingWhiteSpace": "true"})
    return table(spark, d, "supplier").select("s_suppkey", row.alias("r")).select("s_suppkey", "r.gpu", "r.driver", C("r.vram").cast("int").alias("vram_mb"))


@query("redact_source_name", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR length(n) > 40 THEN 'source_audio' ELSE n END AS shown FROM (SELECT c_custkey, c_name || CASE WHEN c_custkey % 4 = 0 THEN ' Unabridged' WHEN c_custkey % 4 = 1 THEN ' with a rather long file name.wav' ELSE '.wav' END AS n FROM customer)")
def redact_source_name(spark, d):
    k = C("c_custkey") % 4
    name = F.concat("c_name", F.when(k == 0, " Unabridged").when(k == 1, " with a rather long file name.wav").otherwise(".wav"))
    hidden = F.lower(name).rlike("audiobook|unabridged|chapter|_19|_20") | (F.length(name) > 40)
    return table(spark, d, "customer").select("c_custkey", F.when(hidden, "source_audio").otherwise(name).alias("shown"))


@query("resolve_voice", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'own' WHEN lang = 'en' THEN 'en-default' ELSE 'fi-default' END AS voice FROM documents")
def resolve_voice(spark, d):
    own = F.when(C("doc_id") % 5 == 0, "own")
    return table(spark, d, "documents").select("doc_id", F.coalesce(own, S.lookup({"fi": "fi-default", "en": "en-default"}, C("lang"), "fi-default")).alias("voice"))


@query("engine_filter", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 0 OR n_nationkey % 4 = 0")
def engine_filter(spark, d):
    k = C("n_nationkey")
    langs = F.array_compact(F.array(F.when(k % 3 != 0, "fi"), F.when(k % 4 == 0, "fi"), F.lit("en")))
    return table(spark, d, "nation").where(F.array_contains(langs, "fi")).select("n_nationkey", "n_name")


@query("src_dispatch", "SELECT p_partkey, (['epub','txt','pdf','pdf'])[p_partkey % 4 + 1] AS reader FROM part")
def src_dispatch(spark, d):
    """The reader that a file's ending asks for; unknown endings are taken for a PDF."""
    name = F.concat(L("Book."), F.element_at(F.array(*map(F.lit, ("EPUB", "txt", "pdf", "doc"))), (C("p_partkey") % 4 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", B.reader_of(name).alias("reader"))


@query("src_lexicon", """SELECT * FROM (VALUES ('fi_abbreviations', 39), ('fi_acronyms', 22), ('fi_units', 20), ('fi_century_suffixes', 8), ('en_abbreviations', 33), ('en_units', 34), ('en_acronyms', 10)) v(lexicon, n)
UNION ALL SELECT 'en_months: ' || m, i FROM (SELECT unnest(['January','February','March','April','May','June','July','August','September','October','November','December']) AS m, unnest(range(12))::INTEGER AS i)""")
def src_lexicon(spark, d):
    """Sizes of the word lists, one of them with an entry taken out, and one whole list in its order."""
    from weftline.sources.lexicons import lexicon

    names = ("fi_abbreviations", "fi_acronyms", "fi_units", "fi_century_suffixes", "en_abbreviations", "en_units", "en_acronyms", "none")
    sizes = lexicon(spark, *names, overrides={"en_acronyms": {"BAFTA": None}}).groupBy("lexicon").agg(F.count("*").cast("int").alias("n"))
    return sizes.unionByName(lexicon(spark, "en_months").select(F.concat("lexicon", L(": "), "key").alias("lexicon"), C("ord").alias("n")))


@query("sql_functions", "SELECT doc_id, 'five' AS said, (length(trim(text)) > 0)::INTEGER AS some FROM documents")
def sql_functions(spark, d):
    """The text functions by name, from SQL."""
    from weftline.functions.sql import register

    register(spark)
    table(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("weftline_documents")
    return spark.sql("SELECT doc_id, spoken_en('5') AS said, CAST(size(text_chunks(text)) > 0 AS INT) AS some FROM weftline_documents")
