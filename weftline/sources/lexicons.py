"""The word lists of the normalizers as small tables: lexicon, ord, key, value."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from weftline.functions import english, lexicon_fi

LEXICONS = {
    "fi_abbreviations": lexicon_fi.ABBREVIATIONS, "fi_acronyms": lexicon_fi.ACRONYMS, "fi_units": lexicon_fi.UNITS, "fi_century_suffixes": lexicon_fi.CENTURY_SUFFIXES, "fi_governors_before": lexicon_fi.BEFORE,
    "fi_governors_after": lexicon_fi.AFTER, "fi_latin": lexicon_fi.LATIN, "fi_names": lexicon_fi.NAMES, "en_abbreviations": english.ABBREVIATIONS, "en_months": english.MONTHS, "en_acronyms": sorted(english.WORD_ACRONYMS),
    "en_units": {k: v[1] for k, v in english.UNITS.items()},
}


def merged(base: Mapping | Iterable, own: Mapping | None) -> Mapping | list:
    """A word list with a user's entries: new keys come after the others, known ones get the new value, those with None go."""
    if own is None:
        return base
    if isinstance(base, Mapping):
        out = dict(base) | dict(own)
        return {k: v for k, v in out.items() if v is not None}
    pairs = [x if isinstance(x, tuple) else (x, x) for x in base]
    out = dict(pairs) | dict(own)
    return [(k, v) if any(isinstance(x, tuple) for x in base) else k for k, v in out.items() if v is not None]


def read_overrides(path: str) -> dict[str, dict]:
    """A user's lists, YAML of lexicon name -> key -> value (null: left out). A file that is missing or broken overrides nothing, with a warning."""
    import logging

    import pyarrow.fs as pafs
    import yaml

    try:
        fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        with fs.open_input_stream(at) as src:
            found = yaml.safe_load(src.read().decode())
    except (OSError, yaml.YAMLError, UnicodeDecodeError) as e:
        logging.getLogger(__name__).warning("no overrides from %s: %s", path, type(e).__name__)
        return {}
    return {k: dict(v) for k, v in found.items() if isinstance(v, Mapping)} if isinstance(found, Mapping) else {}


def lexicon(spark: SparkSession, *names: str, overrides: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Rows of the named lexicons (all of them without a name), with a user's entries if given; a lexicon that isn't there has no rows."""
    rows = []
    for name in names or LEXICONS:
        found = merged(LEXICONS.get(name, []), (overrides or {}).get(name))
        pairs = found.items() if isinstance(found, Mapping) else [x if isinstance(x, tuple) else (x, None) for x in found]
        rows += [(name, i, k, v) for i, (k, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, "lexicon string, ord int, key string, value string")
