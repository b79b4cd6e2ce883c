"""Expression markup: directives that stick until the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: directives as they are written, and malformed ones
DIRECTIVE = r"^\{\{expr:(\S+?)(?:\s+([^}]*))?\}\}\s*$"
LOOSE = r"^\{\{expr:[^}]*\}\}\s*$"
#: Presets as (exaggeration, cfg).
PRESETS = {"whisper": (0.2, 0.35), "calm": (0.4, 0.4), "neutral": (0.6, 0.5), "intense": (0.9, 0.6), "shout": (1.2, 0.7)}


def keyword(text: Column, name: str) -> Column:
    """The last number given for a key, of blank-separated key=value pairs; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?:^|\s){name}=([-+]?\d*\.?\d+)(?=\s|$)"), F.lit(1))
    good = F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.try_element_at(good, F.lit(-1))


def sticky(lines: DataFrame) -> DataFrame:
    """Lines of text of (doc_id, line_no, line) with the directive that holds: preset, exaggeration, cfg. ``default`` clears
    it; malformed directives go without effect."""
    s = F.trim("line")
    name = F.regexp_extract(s, DIRECTIVE, 1)
    args = F.regexp_extract(s, DIRECTIVE, 2)
    none = lambda k: F.lit(None).cast(k)
    cleared = F.struct(none("string").alias("p"), none("double").alias("x"), none("double").alias("c"))
    state = F.when(name == "", None).when(name == "default", cleared).otherwise(F.struct(name.alias("p"), keyword(args, "exag").alias("x"), keyword(args, "cfg").alias("c")))
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    t = lines.withColumn("st", F.last(state, ignorenulls=True).over(w))
    return t.where(~s.rlike(LOOSE) & (s != "")).select("doc_id", "line_no", "line", F.col("st.p").alias("preset"), F.col("st.x").alias("exaggeration"), F.col("st.c").alias("cfg"))


def sentence_states(lines: DataFrame) -> DataFrame:
    """Sentences numbered through a document, with the state of their line."""
    parts = F.filter(F.split(F.trim("line"), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    t = lines.select("doc_id", "line_no", "preset", "exaggeration", "cfg", F.posexplode(parts).alias("k", "sentence"))
    return t.withColumn("sentence_index", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no", "k")) - 1)


def resolved(states: DataFrame) -> DataFrame:
    """Knobs of each sentence: its own, else its preset's, else the default's, within their bounds."""
    def knob(own: str, i: int, most: float) -> Column:
        of = F.create_map(*[F.lit(x) for k, v in PRESETS.items() for x in (k, v[i])])
        return F.least(F.lit(most), F.greatest(F.lit(0.0), F.coalesce(F.col(own), F.try_element_at(of, F.coalesce("preset", F.lit("neutral"))), F.lit(PRESETS["neutral"][i]))))

    return states.withColumn("exaggeration", knob("exaggeration", 0, 2.0)).withColumn("cfg", knob("cfg", 1, 1.0))
