"""The cleaning and heading rules of texts in SQL for DuckDB, for oracles: Unicode classes are spelled out, as its patterns know ASCII ones only."""

from __future__ import annotations

# fixed values: blanks, blanks without the line feed, and signs of words, as in Unicode
_S = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SL = _S.replace(r"\t-\r", r"\t\x0b\x0c\r")
_W = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}"


def _replace(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, '{pattern}', '{by}', 'g')"


def stripped(t: str) -> str:
    return _replace(t, f"^[{_S}]+|[{_S}]+$", "")


def without_pages(t: str) -> str:
    return _replace(t, rf"(?im)^[{_S}]*(?:page|sivu|s\.?|p\.?)?[{_S}]*\p{{Nd}}+[{_S}]*$", "")


def hyphens(t: str) -> str:
    t = _replace(t, rf"\x{{AD}}[{_S}]*\n?[{_S}]*", "")
    t = _replace(t, rf"([a-zäöA-ZÄÖ])-[ \t]*\n[{_S}]*([a-zäö])", r"\1\2")
    return _replace(t, rf"([{_W}])-[ \t]*\n[{_S}]*([A-ZÄÖ0-9a-zäö])", r"\1-\2")


def blanks(t: str) -> str:
    t = f"regexp_replace({t}, '" + r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]" + "', chr(10), 'g')"
    t = _replace(t, f"(?m)[{_SL}]+$", "")
    t = f"array_to_string([replace(x, chr(10), ' ') for x in regexp_split_to_array({t}, '\\n{{2,}}')], chr(10) || chr(10))"
    return stripped(_replace(t, " {2,}", " "))


def clean(t: str) -> str:
    return blanks(hyphens(without_pages(t)))


def heading(s: str) -> str:
    prose = rf"regexp_matches({s}, '[{_W}]\.[{_S}]+[{_W}].*[{_S}]+[{_W}]') AND len([x for x in regexp_split_to_array(substring({s}, instr({s}, '.') + 1), '[{_S}]+') if x <> '']) > 4"
    numbered = rf"regexp_matches({s}, '(?i)^(?:luku|chapter|osa|part|kapitel)[{_S}]+\p{{Nd}}') OR regexp_matches({s}, '^\p{{Nd}}{{1,3}}[.)][{_S}]+[{_W}]') OR regexp_matches({s}, '(?i)^[IVXLC]+[.)][{_S}]+[{_W}]')"
    return rf"(length({s}) > 0 AND length({s}) <= 80 AND NOT ({prose}) AND ({numbered} OR regexp_full_match({s}, '[A-ZÄÖÅ\s]{{4,50}}')))"


#: Lines of documents, each fifth one replaced by a chapter heading with its number.
LINES = """l AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, [CASE WHEN i % 5 = 0 THEN 'Chapter ' || i ELSE x END for x, i in string_split(text, chr(10))] AS ls FROM documents))"""
#: Chapters of lines ``l``.
CHAPTERS = f"""h AS (SELECT *, {heading('s')} AS h FROM (SELECT *, {stripped('line')} AS s FROM l)), p AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM h),
g AS (SELECT doc_id, part, max(CASE WHEN h THEN trim(line) END) AS title, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT h), '') AS raw FROM p GROUP BY ALL),
c AS (SELECT * FROM (SELECT doc_id, part, title, {clean('raw')} AS content FROM g) WHERE content <> ''),
w AS (SELECT doc_id, {clean("string_agg(line, chr(10) ORDER BY n)")} AS content FROM l WHERE doc_id NOT IN (SELECT doc_id FROM c) GROUP BY doc_id)"""


def greedy(pieces: str, most: int) -> str:
    """A list of lists of one piece, packed; a piece that begins with chr(1) stands alone."""
    alone = "starts_with(acc[-1], chr(1)) OR starts_with(x[1], chr(1))"
    return f"list_reduce({pieces}, lambda acc, x: CASE WHEN len(acc) > 0 AND NOT ({alone}) AND length(acc[-1]) + length(x[1]) + 1 <= {most} THEN list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[]))"


def by_words(t: str, most: int) -> str:
    """A text packed by its words."""
    words = f"[[x] for x in regexp_split_to_array({t}, '[{_S}]+') if x <> '']"
    return f"CASE WHEN {stripped(t)} = '' THEN CAST([] AS VARCHAR[]) ELSE {greedy(words, most)} END"
