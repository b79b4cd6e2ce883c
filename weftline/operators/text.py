"""Cleaning, chapters and chunks of long texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import scalars as S

# fixed values: headings
MAX_HEADING = 80
HEADING = r"(?iU)^(?:(?:Luku|Chapter|Osa|Part|Kapitel)\s+\d+|\d{1,3}[.)]\s+\w|[IVXLC]+[.)]\s+\w)"
ALL_CAPS = r"^[A-ZÄÖÅ\s]{4,50}$"
FRONT, WHOLE = "Alkusanat", "Kirja"
#: Line ends that Python's splitlines knows beyond LF.
OTHER_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]"


def heading(line: Column) -> Column:
    """Whether a trimmed line is a heading: short, no prose after its first period, numbered or all in capitals."""
    after = F.regexp_extract(line, r"^[^.]*\.((?s:.*))$", 1)
    words = F.size(F.filter(F.split(after, r"(?U)\s+"), lambda w: w != ""))
    prose = line.rlike(r"(?U)\w\.\s+\w.*\s+\w") & (words > 4)
    return (F.length(line) > 0) & (F.length(line) <= MAX_HEADING) & ~prose & (line.rlike(HEADING) | line.rlike(ALL_CAPS))


# fixed values: the patterns of the cleaning steps
def remove_page_numbers(t: Column) -> Column:
    return F.regexp_replace(t, r"(?imdU)^\s*(?:page|sivu|s\.?|p\.?)?\s*\d+\s*$", "")


def fix_hyphenation(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?U)­\s*\n?\s*", "")
    t = F.regexp_replace(t, r"(?U)([a-zäöA-ZÄÖ])-[ \t]*\n\s*([a-zäö])", "$1$2")
    return F.regexp_replace(t, r"(?U)(\w)-[ \t]*\n\s*([A-ZÄÖ0-9a-zäö])", "$1-$2")


def normalize_whitespace(t: Column) -> Column:
    t = F.regexp_replace(t, OTHER_ENDS, "\n")
    t = F.regexp_replace(t, r"(?mdU)[^\S\n]+$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?<!\n)\n(?!\n)", " ")
    t = F.regexp_replace(t, " {2,}", " ")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def clean_text(t: Column) -> Column:
    return normalize_whitespace(fix_hyphenation(remove_page_numbers(t)))


def simple_sentences(t: Column) -> Column:
    """Sentences by marks and blanks alone."""
    flat = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def lines_with_headings(docs: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, n, line: the lines of texts, each ``every``-th one replaced by a chapter heading with its (1-based) number."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    no = F.col("n") + 1
    return lines.select("doc_id", F.col("n").cast("long").alias("n"), F.when(no % every == 0, F.concat(F.lit("Chapter "), no.cast("string"))).otherwise(F.col("line")).alias("line"))


def split_chapters(lines: DataFrame) -> DataFrame:
    """Chapters of (doc_id, n, line): a heading starts one, text before the first is front matter; chapters without text take no number; a book
    without any is one whole. Returns doc_id, idx, title, content; with a column ``page_no`` also page_start (that of the heading; 1 for front matter)
    and page_end (that of the next heading, or the book's last)."""
    paged = "page_no" in lines.columns
    page = F.col("page_no") if paged else F.lit(None).cast("long")
    w = W.partitionBy("doc_id").orderBy("n")
    line = F.col("line")
    t = lines.select("doc_id", "n", "line", page.alias("page_no")).withColumn("h", heading(F.regexp_replace(line, r"(?U)^\s+|\s+$", "")))
    t = t.withColumn("part", F.sum(F.col("h").cast("int")).over(w))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), "\n")
    g = t.groupBy("doc_id", "part").agg(F.max(F.when(F.col("h"), F.trim("line"))).alias("title"), joined(F.when(~F.col("h"), F.struct("n", "line"))).alias("raw"), F.min(F.when(F.col("h"), F.col("page_no"))).alias("page_start"), F.max("page_no").alias("last"))
    by_part = W.partitionBy("doc_id").orderBy("part")
    g = g.withColumn("page_end", F.coalesce(F.lead("page_start").over(by_part), F.max("last").over(W.partitionBy("doc_id"))))
    g = g.withColumn("content", clean_text(F.col("raw")))
    pages = [F.coalesce("page_start", F.lit(1)).cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end")] if paged else []
    out = g.where(F.col("content") != "").select("doc_id", (F.row_number().over(by_part) - 1).cast("long").alias("idx"), F.coalesce("title", F.lit(FRONT)).alias("title"), "content", *pages)
    none = lines.select("doc_id").distinct().join(out.select("doc_id").distinct(), "doc_id", "left_anti")
    empty = lines.select("doc_id", "n", "line", page.alias("page_no")).join(none, "doc_id").groupBy("doc_id").agg(joined(F.struct("n", "line")).alias("raw"), F.max("page_no").alias("page_end"))
    pages = [F.lit(1).cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end")] if paged else []
    return out.unionByName(empty.select("doc_id", F.lit(0).cast("long").alias("idx"), F.lit(WHOLE).alias("title"), clean_text(F.col("raw")).alias("content"), *pages))


def number_within(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("n", (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("long"))


def prose_chapters(chapters: DataFrame, key: str, order: str) -> DataFrame:
    """Chapters that are prose, numbered from 1."""
    return chapters.where(S.is_prose(F.col("text"))).withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy(order)).cast("long"))


def mapped(f: Callable[[str], object], kind: T.DataType) -> Callable[[Column], Column]:
    """``f`` over Arrow batches of texts; null stays null."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t) for t in texts], dtype=object)

    return run


def sentences(t: Column) -> Column:
    from weftline.functions.sentences import split_sentences

    return mapped(lambda x: [s.strip() for s in split_sentences(x)], T.ArrayType(T.StringType()))(t)


def chunks(t: Column, most: int) -> Column:
    from weftline.functions.sentences import chunk_text

    return mapped(lambda x: chunk_text(x, most), T.ArrayType(T.StringType()))(t)


def split_by_words(t: Column, most: int) -> Column:
    """A text as chunks of whole words of at most ``most`` characters; a longer word stands alone."""
    from weftline.functions.sentences import force_split

    return mapped(lambda x: force_split(x, most), T.ArrayType(T.StringType()))(t)


def packed(pieces: Column, most: int) -> Column:
    """An array of sentences as chunks of at most ``most`` characters; longer sentences are split by words. Greedy, so each chunk depends on the one before:
    in one pass over the array, which a fold in SQL would copy at every step."""
    from weftline.functions.sentences import pack_sentences

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else pack_sentences(a, most) for a in arrays], dtype=object)

    return run(pieces)


def capped(chunks_: Column, most: int) -> Column:
    """The first ``most`` chunks of a chapter; all of them where ``most`` is 0."""
    return F.slice(chunks_, 1, most) if most > 0 else chunks_
