"""Spoken Finnish: inflected numbers, and the ordered passes of the normalizer."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

from weftline.functions.english import capital_runs, within
from weftline.functions.lexicon_fi import (
    ABBREVIATIONS, ACRONYMS, AFTER, BEFORE, CENTURY_SUFFIXES, DIGIT_PREFIXES, ISMI_STEMS, LATIN, MONTHS, MORPHEME_STEMS, NAMES, NOT_ACRONYMS,
    ORDINAL_AFTER, ORDINAL_BEFORE, REGNAL, ROMAN_NOT, TIO_STEMS, TITLES, UNITS, YEAR_WORDS,
)

# fixed values: number words as (nominative, partitive, weak stem, essive stem, illative)
DIGITS = [
    ("nolla", "nollaa", "nolla", "nolla", "nollaan"), ("yksi", "yhtä", "yhde", "yhte", "yhteen"), ("kaksi", "kahta", "kahde", "kahte", "kahteen"),
    ("kolme", "kolmea", "kolme", "kolme", "kolmeen"), ("neljä", "neljää", "neljä", "neljä", "neljään"), ("viisi", "viittä", "viide", "viite", "viiteen"),
    ("kuusi", "kuutta", "kuude", "kuute", "kuuteen"), ("seitsemän", "seitsemää", "seitsemä", "seitsemä", "seitsemään"),
    ("kahdeksan", "kahdeksaa", "kahdeksa", "kahdeksa", "kahdeksaan"), ("yhdeksän", "yhdeksää", "yhdeksä", "yhdeksä", "yhdeksään"),
]
TEN, HUNDRED, THOUSAND = ("kymmenen", "kymmentä", "kymmene", "kymmene", "kymmeneen"), ("sata", "sataa", "sada", "sata", "sataan"), ("tuhat", "tuhatta", "tuhanne", "tuhante", "tuhanteen")
LARGE = [(10**9, ("miljardi", "miljardia", "miljardi", "miljardi", "miljardiin")), (10**6, ("miljoona", "miljoonaa", "miljoona", "miljoona", "miljoonaan"))]
# fixed values: endings of cases; A stands for a or ä
ENDINGS = {"genitive": "n", "inessive": "ssA", "elative": "stA", "adessive": "llA", "ablative": "ltA", "allative": "lle"}
# fixed values: ordinals, alone and within a compound
ORDINALS = ["nollas", "ensimmäinen", "toinen", "kolmas", "neljäs", "viides", "kuudes", "seitsemäs", "kahdeksas", "yhdeksäs"]
PART_ORDINALS = [*ORDINALS[:1], "yhdes", "kahdes", *ORDINALS[3:]]

Word = tuple[str, str, str, str, str]


def inflected(word: Word, case: str) -> str:
    if case == "nominative":
        return word[0]
    if case == "partitive":
        return word[1]
    if case == "illative":
        return word[4]
    front = not re.search("[aou]", word[2])
    vowel = "ä" if front else "a"
    if case == "essive":
        return word[3] + "n" + vowel
    return word[2] + ENDINGS[case].replace("A", vowel)


def cardinal(n: int, case: str = "nominative") -> str:
    """All parts agree in case; in the nominative a counted ten, hundred or thousand is in the partitive.
    Thousands and larger units stand apart from what follows."""
    if n < 0:
        return "miinus " + cardinal(-n, case)
    if n >= 10**12:
        return str(n)
    unit = lambda k, w, glue="": (cardinal(k, case) + glue if k > 1 else "") + inflected(w, "partitive" if k > 1 and case == "nominative" else case)
    for size, word in LARGE:
        if n >= size:
            high, low = divmod(n, size)
            return unit(high, word, " ") + (" " + cardinal(low, case) if low else "")
    if n >= 1000:
        high, low = divmod(n, 1000)
        return unit(high, THOUSAND) + (" " + cardinal(low, case) if low else "")
    out = ""
    if n >= 100:
        out, n = unit(n // 100, HUNDRED), n % 100
        if not n:
            return out
    if n < 10:
        return out + inflected(DIGITS[n], case)
    if n == 10:
        return out + inflected(TEN, case)
    if n < 20:
        return out + inflected(DIGITS[n - 10], case) + "toista"
    return out + unit(n // 10, TEN) + (inflected(DIGITS[n % 10], case) if n % 10 else "")


def ordinal(n: int) -> str:
    """kolmas, neljästoista, kahdeskymmenes; what counts a unit is an ordinal too."""
    def part(k: int, word: str) -> str:
        return ("" if k == 1 else _inner(k)) + word

    def _inner(k: int) -> str:
        return PART_ORDINALS[k] if k < 10 else ordinal(k)

    if n < 10:
        return ORDINALS[n]
    if n == 10:
        return "kymmenes"
    if n < 20:
        return PART_ORDINALS[n - 10] + "toista"
    for size, word in ((10**6, "miljoonas"), (1000, "tuhannes"), (100, "sadas"), (10, "kymmenes")):
        if n >= size:
            high, low = divmod(n, size)
            return part(high, word) + (ordinal(low) if low else "")
    raise ValueError(n)


def decimal(whole: str, part: str) -> str:
    part = part.rstrip("0")
    said = cardinal(int(whole))
    return said + (" pilkku " + " ".join(cardinal(int(d)) for d in part) if part else "")


_WORD = re.compile(r"[^\W\d_]+")
_NUMBER_OR_WORD = re.compile(r"(?P<num>\d+)|(?P<word>[^\W\d_]+)")


def roman(s: str) -> int | None:
    from weftline.functions.english import roman as value

    return value(s) if s else None


def _romans(text: str) -> str:
    found = [(m.start(), m[0]) for m in _WORD.finditer(text)]
    at = [a for a, _ in found]

    def say(m: re.Match[str]) -> str:
        n = None if m[0] in ROMAN_NOT else roman(m[0])
        if n is None:
            return m[0]
        i, j = bisect.bisect_left(at, m.start()), bisect.bisect_left(at, m.end())
        before, after = (found[i - 1][1] if i else None), (found[j][1] if j < len(at) else None)
        return ordinal(n) if before in REGNAL or before in TITLES or before in ORDINAL_BEFORE or after in ORDINAL_AFTER else cardinal(n)

    return re.sub(r"\b[IVXLCDM]{2,}\b", say, text)


def heading_runs(text: str, least: int = 3) -> list[tuple[int, int, int, int]]:
    return capital_runs(text, re.compile("[A-ZÅÄÖ]{2,}"), least)


def _unknown_acronyms(text: str) -> str:
    inside = within([(a, b) for a, b, _, _ in heading_runs(text)])
    return re.sub(r"\b[A-Z]{2,4}\b", lambda m: m[0] if m[0] in NOT_ACRONYMS or inside(m) else " ".join(m[0]), text)


def governed_case(words: list[str], i: int, n: int, full_years: bool, reach: int = 3) -> str:
    """The case that the nearest governor among ``reach`` words before, else after, asks for; ``i`` is the number of
    words before. Years are left in the nominative after a word for year, as on the radio, unless ``full_years``."""
    for w in reversed(words[max(0, i - reach) : i]):
        if w in BEFORE:
            return "nominative" if not full_years and w in YEAR_WORDS and 1000 <= n <= 2100 else BEFORE[w]
    return next((AFTER[w] for w in words[i : i + reach] if w in AFTER), "nominative")


def numbers_with_case(text: str, full_years: bool = False) -> list[tuple[re.Match[str], int, str]]:
    """Each number of a text (its match and value) with the case that its surroundings ask for."""
    found = list(_NUMBER_OR_WORD.finditer(text))
    at, words = [m.start() for m in found if m["word"]], [m["word"].lower() for m in found if m["word"]]
    return [(m, int(m["num"]), governed_case(words, bisect.bisect_left(at, m.start()), int(m["num"]), full_years)) for m in found if m["num"]]


def _numbers(text: str, full_years: bool) -> str:
    out, cursor = [], 0
    for m, n, case in numbers_with_case(text, full_years):
        out += [text[cursor : m.start()], cardinal(n, case)]
        cursor = m.end()
    return "".join(out) + text[cursor:]


def _either(keys: list[str] | dict[str, str]) -> str:
    return "|".join(re.escape(k) for k in sorted(keys, key=len, reverse=True))


_ABBREVIATION = re.compile(rf"(?i)\b({_either(ABBREVIATIONS)})")
_NAME, _ACRONYM = re.compile(rf"\b({_either(NAMES)})\b"), re.compile(rf"\b({_either(ACRONYMS)})\b")
_LATIN = [(re.compile(rf"(?i)(?<!\w){re.escape(p)}(?!\w)"), LATIN[p]) for p in sorted(LATIN, key=len, reverse=True)]


def _abbreviations(text: str) -> str:
    say = lambda m: ABBREVIATIONS.get(m[1].lower(), ABBREVIATIONS.get(m[1], m[1]))
    return re.sub(r"\btri(?=\s+[A-ZÄÖÅ])", "tohtori", _ABBREVIATION.sub(say, text))


def _date(m: re.Match[str]) -> str:
    day, month, year = map(int, m.groups())
    return f"{ordinal(day)} {MONTHS[month - 1]} {cardinal(year)}" if 1 <= day <= 31 and 1 <= month <= 12 else m[0]


def _clock(m: re.Match[str]) -> str:
    h, minute = map(int, m.groups())
    return f"kello {cardinal(h)} {cardinal(minute)}" if h <= 23 and minute <= 59 else m[0]


_UNIT_WORD = dict(UNITS)


def _units(text: str) -> str:
    text = re.sub(r"\$\s*(\d+(?:[.,]\d+)?)", r"\1 dollaria", text)
    text = re.sub(r"§\s*(?=\d)", "pykälä ", text)
    return re.sub(rf"(-?\d+(?:[.,]\d+)?)\s*({'|'.join(re.escape(u) for u, _ in UNITS)})(?!\w)", lambda m: f"{m[1]} {_UNIT_WORD[m[2]]}", text)


def _respelled(stems: frozenset[str], ending: str, joined: Callable[[str], str]) -> Callable[[str], str]:
    pattern = re.compile(rf"(?i)\b(\w+?){ending}(\w*)\b")
    return lambda t: pattern.sub(lambda m: joined(m[1]) + m[2] if m[1].lower() in stems else m[0], t)


_ismi = _respelled(ISMI_STEMS, "ismi", lambda stem: stem + "is-mi")
_tio = _respelled(TIO_STEMS, "tio", lambda stem: stem + "-tio")


def _loanwords(text: str) -> str:
    text = _NAME.sub(lambda m: NAMES[m[1]], text)
    for phrase, said in _LATIN:
        text = phrase.sub(said, text)
    return _tio(_ismi(text))


EMOJI = re.compile("[\U0001f300-\U0001f64f\U0001f680-\U0001f9ff\U0001fa00-\U0001faff\U0001f1e6-\U0001f1ff☀-⛿✂-➰️‍]+")

# fixed values: the patterns of the passes, and those of dates, times and units above
#: The passes in the order in which they run.
PASSES: list[tuple[str, Callable[[str], str]]] = [
    ("emoji", lambda t: EMOJI.sub(" ", t)),
    ("citations", lambda t: re.sub(r"\s*\(([^()]*?\b[A-ZÅÄÖ][\wäöåÄÖÅ]+[^()]*?\b\d{4}[a-z]?\b[^()]*?)\)", "", t)),
    ("metadata", lambda t: re.sub(r"(?i)\s*\([^()]*(?:ISBN|DOI|Creative Commons|CC\s*BY|CC0|CC\s*4\.0|eISBN)[^()]*\)", "", t)),
    ("ellipsis", lambda t: re.sub(r"(?<!\S)\.{3,}(?!\S)", "…", t)),
    ("toc", lambda t: re.sub(r"\s*\.{4,}\s*\d+\b", " ", t)),
    ("isbn", lambda t: re.sub(r"(?i)\b(?:ISBN[\s:-]*)?97[89][- ]?\d{1,5}[- ]?\d{1,7}[- ]?\d{1,7}[- ]?\d\b", "", t)),
    ("elided", lambda t: re.sub(r"(?i)(\w+)-(ja|tai|eli|sekä)\b", r"\1- \2", t)),
    ("abbreviations", _abbreviations),
    ("dates", lambda t: re.sub(r"(?i)\b(?:klo|kello)\s+(\d{1,2}):(\d{2})\b", _clock, re.sub(r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", _date, t))),
    ("roman", _romans),
    ("acronyms", lambda t: _ACRONYM.sub(lambda m: ACRONYMS[m[1]], t)),
    ("acronym_fallback", _unknown_acronyms),
    ("units", _units),
    ("century", lambda t: re.sub(rf"(\d+)-({'|'.join(CENTURY_SUFFIXES)})\b", lambda m: f"{cardinal(int(m[1]))} {m[2]}", t)),
    ("range", lambda t: re.sub(r"(\d{1,4})\s*[-–]\s*(\d{1,4})\b", r"\1 \2", t)),
    ("page", lambda t: re.sub(r"\bs(s?)\.\s+(?=\d)", lambda m: "sivut " if m[1] else "sivu ", t)),
    ("decimal", lambda t: re.sub(r"(\d+)[.,](\d+)", lambda m: decimal(m[1], m[2]), t)),
    ("governed", lambda t: _numbers(t, False)),
    ("loanword", _loanwords),
    ("morpheme", lambda t: re.sub(rf"({'|'.join(MORPHEME_STEMS)})(?={'|'.join(DIGIT_PREFIXES)})", r"\1 ", t)),
    ("blanks", lambda t: re.sub(r" +([.,;:!?])", r"\1", re.sub(r"[ \t]+", " ", t))),
]
_BY_NAME = dict(PASSES)
#: What a text must hold for a pass to find anything.
_NEEDS = {
    "citations": re.compile(r"\("), "metadata": re.compile(r"\("), "ellipsis": re.compile(r"\.\.\."), "toc": re.compile(r"\.\.\.\."), "isbn": re.compile(r"97[89]"),
    "elided": re.compile("-"), "abbreviations": re.compile(r"\.|tri"), "roman": re.compile("[IVXLCDM]{2}"), "acronyms": re.compile("[A-Z]{2}"), "acronym_fallback": re.compile("[A-Z]{2}"),
    "morpheme": re.compile("kymme|sa[dt][aao]"),
}
_NEEDS |= dict.fromkeys(("dates", "units", "century", "range", "page", "decimal", "governed"), re.compile(r"\d"))


def run_pass(name: str, text: str) -> str:
    need = _NEEDS.get(name)
    return text if need is not None and need.search(text) is None else _BY_NAME[name](text)


def normalize(text: str, *, drop_citations: bool = True, full_years: bool = False) -> str:
    """All passes in order; an empty text stays as it is. ``full_years`` inflects years as any number."""
    if text:
        for name, _ in PASSES:
            if name in ("citations", "metadata") and not drop_citations:
                continue
            text = _numbers(text, True) if name == "governed" and full_years else run_pass(name, text)
    return text
