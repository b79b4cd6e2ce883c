"""Queries of cleaning, chapters, sentences, chunks and expression markup."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import markup as M
from weftline.operators import text as X
from weftline.plans import cleaning_sql as Q
from weftline.plans.registry import query
from weftline.session import spread, table

def _raw(spark, d):
    """Documents with a page number after each paragraph, and hyphens at line ends."""
    t = F.regexp_replace(F.col("text"), "\n", "\n Page 12 \n\n\n")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.concat(t, F.lit("\nend-\nof the li-\nne "), (F.col("doc_id") % 9).cast("string"), F.lit("-\nAb\u00ad\n cd")).alias("raw"))


_RAW_SQL = """raw AS (SELECT doc_id, replace(text, chr(10), chr(10) || ' Page 12 ' || chr(10) || chr(10) || chr(10)) || chr(10) || 'end-' || chr(10) || 'of the li-' || chr(10) || 'ne ' || doc_id % 9 || '-' || chr(10) || 'Ab' || chr(173) || chr(10) || ' cd' AS r FROM documents)"""


@query("remove_page_numbers", f"WITH {_RAW_SQL} SELECT doc_id, md5({Q.without_pages('r')}) AS digest FROM raw")
def remove_page_numbers(spark, d):
    return _raw(spark, d).select("doc_id", F.md5(X.remove_page_numbers(F.col("raw")).cast("binary")).alias("digest"))


@query("fix_hyphenation", f"WITH {_RAW_SQL} SELECT doc_id, {Q.hyphens('r')} AS t FROM raw")
def fix_hyphenation(spark, d):
    return _raw(spark, d).select("doc_id", X.fix_hyphenation(F.col("raw")).alias("t"))


@query("normalize_ws", f"WITH {_RAW_SQL} SELECT doc_id, {Q.blanks('r')} AS t FROM raw")
def normalize_ws(spark, d):
    return _raw(spark, d).select("doc_id", X.normalize_whitespace(F.col("raw")).alias("t"))


@query("clean_text", f"WITH {_RAW_SQL} SELECT doc_id, {Q.clean('r')} AS t FROM raw")
def clean_text(spark, d):
    return _raw(spark, d).select("doc_id", X.clean_text(F.col("raw")).alias("t"))


@query("split_sentences_simple", r"""SELECT doc_id, s.k - 1 AS k, s.t AS sentence FROM (SELECT doc_id, unnest([struct_pack(k := i, t := x) for x, i in
  string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))]) AS s FROM documents) WHERE trim(s.t) <> ''""")
def split_sentences_simple(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.simple_sentences(F.col("text"))).alias("k", "sentence")).select("doc_id", F.col("k").cast("long").alias("k"), "sentence")


@query("split_sentences")
def split_sentences(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("k", "sentence"))


_CHUNKS = 300


_SENTENCES = r"[x for x in string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) if trim(x) <> '']"


@query("pack_chunks", f"""WITH s AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM (SELECT doc_id, {_SENTENCES} AS a FROM documents)),
f AS (SELECT doc_id, i, CASE WHEN length(x) > 300 THEN [[chr(1) || y] for y in {Q.by_words('x', 300)}] ELSE [[x]] END AS p FROM s),
a AS (SELECT doc_id, flatten(list(p ORDER BY i)) AS a FROM f GROUP BY doc_id), c AS (SELECT doc_id, [replace(x, chr(1), '') for x in {Q.greedy('a', 300)}] AS c FROM a)
SELECT doc_id, len(c) AS chunks, list_max([length(x) for x in c]) AS longest, md5(array_to_string(c, '|')) AS digest FROM c""")
def pack_chunks(spark, d):
    c = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.packed(X.simple_sentences(F.col("text")), _CHUNKS).alias("c")).where(F.size("c") > 0)
    return c.select("doc_id", F.size("c").cast("long").alias("chunks"), F.array_max(F.transform("c", F.length)).cast("long").alias("longest"), F.md5(F.array_join("c", "|").cast("binary")).alias("digest"))


@query("force_split", f"""SELECT doc_id, parts FROM (SELECT doc_id, ({Q.by_words('text', 100)})::VARCHAR[] AS parts FROM documents) WHERE len(parts) > 0""")
def force_split(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.split_by_words(F.col("text"), 100).alias("parts")).where(F.size("parts") > 0)


@query("chunk_documents")
def chunk_documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(X.chunks(F.col("text"), _CHUNKS)).alias("chunk_idx", "chunk"))


@query("prepare_chunks")
def prepare_chunks(spark, d):
    """All chunks of the English documents as they are spoken."""
    from weftline.functions import scalars as S
    from weftline.operators.normalize import spoken

    docs = spread(table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(X.chunks(spoken(S.sentence_start(F.col("text")), "en"), _CHUNKS)).alias("chunk_idx", "chunk"))


@query("strip_emoji", "SELECT p_partkey, trim(p_name) || ' ' || p_size AS t FROM part")
def strip_emoji(spark, d):
    from weftline.functions.patterns import EMOJI

    return table(spark, d, "part").select("p_partkey", F.regexp_replace(F.concat("p_name", F.lit("\U0001f600\U0001f680"), F.col("p_size").cast("string")), EMOJI, " ").alias("t"))


@query("book_totals", "SELECT source, doc_id // 50 AS book, count(*) AS chapters, sum(length(text))::BIGINT AS chars, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY ALL")
def book_totals(spark, d):
    """Books of a source's documents, up to fifty chapters each."""
    book = F.floor(F.col("doc_id") / 50).alias("book")
    g = table(spark, d, "documents").groupBy("source", book).agg(F.count("*").alias("chapters"), F.sum(F.length("text")).alias("chars"), F.expr("listagg(text, '\n\n') within group (order by doc_id)").alias("t"))
    return g.select("source", "book", "chapters", "chars", F.md5(F.col("t").cast("binary")).alias("digest"))


@query("split_chapters", f"""WITH {Q.LINES}, {Q.CHAPTERS}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS idx, coalesce(title, 'Alkusanat') AS title, content FROM c UNION ALL SELECT doc_id, 0, 'Kirja', content FROM w WHERE content <> ''""")
def split_chapters(spark, d):
    return X.split_chapters(X.lines_with_headings(spread(table(spark, d, "documents").select("doc_id", "text")))).where("content <> ''")


@query("dry_run_plan", "WITH c AS (SELECT source, doc_id % 10 AS chapter, sum(length(text))::BIGINT AS chars, sum(ceil(length(text) / 300.0))::BIGINT AS chunks FROM documents GROUP BY ROLLUP (source, chapter)) SELECT source, chapter, chars, chunks, chunks * 15 AS audio_s, round(chunks * 15 * 0.17, 6) AS synth_s FROM c")
def dry_run_plan(spark, d):
    c = table(spark, d, "documents").select("source", (F.col("doc_id") % 10).alias("chapter"), F.length("text").alias("n"))
    g = c.rollup("source", "chapter").agg(F.sum("n").alias("chars"), F.sum(F.ceil(F.col("n") / 300.0)).alias("chunks"))
    return g.select("source", "chapter", "chars", "chunks", (F.col("chunks") * 15).alias("audio_s"), F.round(F.col("chunks") * 15 * 0.17, 6).alias("synth_s"))


_MARK_SQL = """line AS (SELECT conv_id AS doc_id, turn * 2 + k AS line_no, CASE WHEN k = 1 THEN text WHEN turn % 5 = 3 THEN '{{expr: }}' WHEN turn % 4 = 2 THEN '{{expr:default}}' WHEN role = 'assistant' THEN '{{expr:whisper exag=0.' || turn % 9 || ' cfg=0.5}}' ELSE '{{expr:calm}}' END AS line
  FROM conversations, (VALUES (0), (1)) v(k)),
st AS (SELECT *, CASE WHEN line = '{{expr:default}}' THEN '-' WHEN line LIKE '{{expr:%}}' AND line <> '{{expr: }}' THEN string_split(replace(replace(line, '{{expr:', ''), '}}', ''), ' ')[1] END AS p,
  CASE WHEN line LIKE '{{expr:%exag=%' THEN regexp_extract(line, 'exag=([0-9.]+)', 1)::DOUBLE END AS x, line LIKE '{{expr:%' AS mark FROM line),
sticky AS (SELECT *, last_value(p IGNORE NULLS) OVER w AS preset, last_value(CASE WHEN p IS NOT NULL THEN coalesce(x, -1) END IGNORE NULLS) OVER w AS exag FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""


def _markup(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    s = lambda x: F.lit("{{" + x)
    mark = F.when(F.col("turn") % 5 == 3, s("expr: }}")).when(F.col("turn") % 4 == 2, s("expr:default}}")).when(F.col("role") == "assistant", F.concat(s("expr:whisper exag=0."), (F.col("turn") % 9).cast("string"), F.lit(" cfg=0.5}}"))).otherwise(s("expr:calm}}"))
    return c.select("doc_id", (F.col("turn") * 2 + F.col("k")).alias("line_no"), F.when(F.col("k") == 1, F.col("text")).otherwise(mark).alias("line"))


@query("expression_sticky", f"WITH {_MARK_SQL} SELECT doc_id, line_no, nullif(preset, '-') AS preset, nullif(exag, -1) AS exaggeration FROM sticky WHERE NOT mark AND trim(line) <> ''")
def expression_sticky(spark, d):
    return M.sticky(_markup(spark, d)).select("doc_id", "line_no", "preset", "exaggeration")


@query("sentence_index", rf"""WITH {_MARK_SQL}, s AS (SELECT doc_id, line_no, preset, unnest([struct_pack(k := i, t := x) for x, i in string_split(regexp_replace(trim(line), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if trim(x) <> '']) AS q FROM sticky WHERE NOT mark AND trim(line) <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, q.k) - 1 AS sentence_index, nullif(preset, '-') AS preset FROM s""")
def sentence_index(spark, d):
    return M.sentence_states(M.sticky(_markup(spark, d))).select("doc_id", F.col("sentence_index").cast("long").alias("sentence_index"), "preset")


@query("resolve_expression", rf"""WITH {_MARK_SQL}, s AS (SELECT doc_id, line_no, preset, exag, unnest([struct_pack(k := i, t := x) for x, i in string_split(regexp_replace(trim(line), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if trim(x) <> '']) AS q FROM sticky WHERE NOT mark AND trim(line) <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, q.k) - 1 AS sentence_index, least(2.0, greatest(0.0, CASE WHEN exag >= 0 THEN exag WHEN preset = 'whisper' THEN 0.2 WHEN preset = 'calm' THEN 0.4 ELSE 0.6 END))::DOUBLE AS exaggeration FROM s""")
def resolve_expression(spark, d):
    return M.resolved(M.sentence_states(M.sticky(_markup(spark, d)))).select("doc_id", F.col("sentence_index").cast("long").alias("sentence_index"), "exaggeration")


@query("parse_kwargs", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (event_id % 20) / 10.0::DOUBLE END AS exag, CASE WHEN event_id % 4 = 0 THEN 0.5::DOUBLE END AS cfg FROM events")
def parse_kwargs(spark, d):
    e = F.col("event_id")
    text = F.concat(F.lit("speed=3 "), F.when(e % 3 != 0, F.concat(F.lit("exag="), ((e % 20) / 10.0).cast("string"))).otherwise("exag=high"), F.when(e % 4 == 0, " cfg=0.5").otherwise(""))
    return table(spark, d, "events").select("event_id", M.keyword(text, "exag").alias("exag"), M.keyword(text, "cfg").alias("cfg"))
