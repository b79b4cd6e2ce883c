"""Spoken English: numbers as words, and the ordered passes of the normalizer.

A pass is a list of rules, a pattern with what to say for a match; the order of passes is part of the meaning.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

# fixed values: number words
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion", "sextillion", "septillion", "octillion", "nonillion", "decillion"]
ODD_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
PLURAL_TENS = {"twenty": "twenties", "thirty": "thirties", "forty": "forties", "fifty": "fifties", "sixty": "sixties", "seventy": "seventies", "eighty": "eighties", "ninety": "nineties"}
DENOMINATORS = {2: "half", 3: "third", 4: "quarter", 5: "fifth", 6: "sixth", 7: "seventh", 8: "eighth", 9: "ninth", 10: "tenth", 11: "eleventh", 12: "twelfth", 16: "sixteenth", 32: "thirty-second", 64: "sixty-fourth", 100: "hundredth"}

# fixed values: abbreviations, in the order of their replacement
ABBREVIATIONS = [
    ("i.e.", "that is"), ("e.g.", "for example"), ("etc.", "et cetera"), ("cf.", "compare"), ("vs.", "versus"), ("vs", "versus"), ("viz.", "namely"),
    ("a.m.", "a m"), ("p.m.", "p m"), ("A.M.", "A M"), ("P.M.", "P M"), ("Mr.", "Mister"), ("Mrs.", "Misses"), ("Ms.", "Miss"), ("Dr.", "Doctor"),
    ("Prof.", "Professor"), ("Rev.", "Reverend"), ("Hon.", "Honorable"), ("Sr.", "Senior"), ("Jr.", "Junior"), ("Mt.", "Mount"), ("Ft.", "Fort"),
    ("U.S.A.", "U S A"), ("U.S.", "United States"), ("U.K.", "United Kingdom"), ("U.N.", "United Nations"), ("No.", "Number"), ("Vol.", "Volume"),
    ("Ch.", "Chapter"), ("Fig.", "Figure"), ("Eq.", "Equation"), ("pp.", "pages"), ("p.", "page"),
]
# fixed values: words before a Roman numeral
ROMAN_CARDINAL = frozenset("Chapter Book Part Volume Section Act Scene Article Appendix Figure Table Phase Stage Episode Series".split())
ROMAN_REGNAL = frozenset(
    "Pope King Queen Emperor Empress Tsar Sultan Louis Henry Edward George William Richard Charles James Elizabeth Mary Victoria Albert Frederick "
    "Philip Napoleon Nicholas Alexander Peter Paul John Pius Benedict Leo Gregory Innocent Clement Urban Boniface".split()
)
# fixed values: acronyms that are read as words
WORD_ACRONYMS = frozenset("NASA NATO UNESCO OPEC RAM ROM LASER RADAR SCUBA IKEA BAFTA".split())
# fixed values: months by name and short name
MONTHS = "January February March April May June July August September October November December".split()
MONTH_OF = {name.lower(): i + 1 for i, name in enumerate(MONTHS)} | {name[:3].lower(): i + 1 for i, name in enumerate(MONTHS)} | {"sept": 9}
MONTH_DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
# fixed values: units as (singular, plural)
UNITS = {
    "km": ("kilometer", "kilometers"), "cm": ("centimeter", "centimeters"), "mm": ("millimeter", "millimeters"), "m": ("meter", "meters"), "mi": ("mile", "miles"),
    "ft": ("foot", "feet"), "in": ("inch", "inches"), "yd": ("yard", "yards"), "kg": ("kilogram", "kilograms"), "g": ("gram", "grams"), "mg": ("milligram", "milligrams"),
    "lb": ("pound", "pounds"), "lbs": ("pound", "pounds"), "oz": ("ounce", "ounces"), "l": ("liter", "liters"), "ml": ("milliliter", "milliliters"), "gal": ("gallon", "gallons"),
    "mph": ("mile per hour", "miles per hour"), "kph": ("kilometer per hour", "kilometers per hour"), "kb": ("kilobyte", "kilobytes"), "mb": ("megabyte", "megabytes"),
    "gb": ("gigabyte", "gigabytes"), "tb": ("terabyte", "terabytes"), "kib": ("kibibyte", "kibibytes"), "mib": ("mebibyte", "mebibytes"), "gib": ("gibibyte", "gibibytes"),
    "hz": ("hertz", "hertz"), "khz": ("kilohertz", "kilohertz"), "mhz": ("megahertz", "megahertz"), "ghz": ("gigahertz", "gigahertz"), "ms": ("millisecond", "milliseconds"),
    "s": ("second", "seconds"), "min": ("minute", "minutes"), "hr": ("hour", "hours"),
}
DEGREES = {"C": ("degree Celsius", "degrees Celsius"), "F": ("degree Fahrenheit", "degrees Fahrenheit"), "K": ("kelvin", "kelvin")}
# fixed values: currencies as (singular, plural, cent, cents)
DOLLAR, POUND, EURO = ("dollar", "dollars", "cent", "cents"), ("pound", "pounds", "penny", "pence"), ("euro", "euros", "cent", "cents")
SYMBOLS = {"$": DOLLAR, "£": POUND, "€": EURO, "¥": ("yen", "yen"), "₹": ("rupee", "rupees"), "₽": ("rouble", "roubles")}
CODES = {"USD": DOLLAR, "GBP": POUND, "EUR": EURO, "JPY": ("yen", "yen"), "INR": ("rupee", "rupees")}
MAGNITUDES = {"K": "thousand", "M": "million", "B": "billion", "T": "trillion"}
# fixed values: signs that are made plain
PLAIN_SIGNS = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": " - ", " ": " "})
AMOUNT = r"\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?"
# fixed values: signs of an address, as spoken
ADDRESS_SIGNS = (("://", " "), ("@", " at "), (".", " dot "), ("/", " slash "), ("?", " question "), ("=", " equals "), ("&", " and "), ("#", " hash "), (":", " colon "))


def cardinal(n: int) -> str:
    """one thousand, two hundred and thirty-four"""
    if n < 0:
        return "minus " + cardinal(-n)
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10] + ("-" + ONES[n % 10] if n % 10 else "")
    if n < 1000:
        return ONES[n // 100] + " hundred" + (" and " + cardinal(n % 100) if n % 100 else "")
    groups, scale = [], 0
    while n:
        n, g = divmod(n, 1000)
        if g:
            groups.append((g, scale))
        scale += 1
    if groups[-1][1] >= len(SCALES):
        return str(sum(g * 1000**s for g, s in groups))
    said = [cardinal(g) + (" " + SCALES[s] if s else "") for g, s in reversed(groups)]
    low = groups[0]
    if len(said) > 1 and low[1] == 0 and low[0] < 100:
        return ", ".join(said[:-1]) + " and " + said[-1]
    return ", ".join(said)


def ordinal(n: int) -> str:
    head, last = re.fullmatch(r"(.*?)([a-z]+)", cardinal(n), re.S).groups()
    return head + (ODD_ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th"))


def year(n: int) -> str:
    """nineteen oh-one, nineteen hundred, two thousand and five, twenty twenty"""
    high, low = divmod(n, 100)
    if high == 0 or (high % 10 == 0 and low < 10) or high >= 100:
        return cardinal(n)
    return f"{cardinal(high)} " + ("hundred" if low == 0 else f"oh-{cardinal(low)}" if low < 10 else cardinal(low))


def digits(s: str) -> str:
    return " ".join(ONES[int(c)] for c in s)


def decade(n: int) -> str:
    if n % 100 == 0:
        return cardinal(n) + "s"
    head, _, last = year(n).rpartition(" ")
    return f"{head} {PLURAL_TENS[last]}".strip() if last in PLURAL_TENS else year(n) + "s"


def amount(s: str) -> tuple[str, float]:
    s = s.replace(",", "")
    whole, _, part = s.partition(".")
    value = float(s)
    return (cardinal(int(value)) if value == int(value) else f"{cardinal(int(whole))} point {digits(part)}"), value


def counted(s: str, names: tuple[str, ...]) -> str:
    said, value = amount(s)
    return f"{said} {names[0] if value == 1 else names[1]}"


def money(s: str, magnitude: str | None, names: tuple[str, ...]) -> str:
    if magnitude:
        return f"{amount(s)[0]} {MAGNITUDES[magnitude]} {names[1]}"
    if "." not in s or len(names) < 4:
        return counted(s, names)
    whole, _, part = s.replace(",", "").partition(".")
    cents = int((part + "00")[:2])
    said = counted(whole, names)
    return said + (f" and {counted(str(cents), names[2:])}" if cents else "")


def roman(s: str) -> int | None:
    """The value of a numeral in its one right spelling, up to 3999."""
    m = re.fullmatch(r"(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})", s.upper())
    if not m or not s:
        return None
    value = dict(zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True))
    ns = [value[c] for c in s.upper()]
    return sum(-a if b > a else a for a, b in zip(ns, [*ns[1:], 0], strict=True))


def _date(day: int, month: int, y: int | None, day_first: bool) -> str | None:
    if not (1 <= month <= 12 and 1 <= day <= MONTH_DAYS[month - 1]):
        return None
    said = f"the {ordinal(day)} of {MONTHS[month - 1]}" if day_first else f"{MONTHS[month - 1]} {ordinal(day)}"
    return said + (" " + year(y).replace("oh-", "oh ") if y is not None else "")


def _time(h: int, m: int) -> str:
    if m == 0:
        return cardinal(h) + (" o'clock" if 1 <= h <= 12 else " hundred hours")
    return f"{cardinal(h)} {'oh ' if m < 10 else ''}{cardinal(m)}"


def _address(m: re.Match[str]) -> str:
    body = m[0].rstrip(".,;:!?)")
    tail = m[0][len(body) :]
    for sign, word in ADDRESS_SIGNS:
        body = body.replace(sign, word)
    return " ".join(re.sub(r"(?i)\bwww\b", "w w w", body).split()) + tail


def capital_runs(text: str, word: re.Pattern[str], least: int) -> list[tuple[int, int, int, int]]:
    """Runs of ``least`` or more neighbouring words (without the signs around them) that ``word`` matches: begin, end, number of the first word, words."""
    spans, run = [], []
    for k, t in enumerate([*re.finditer(r"\S+", text), None]):
        if t is not None and word.fullmatch(t[0].strip(".,:;!?\"'()[]{}")):
            run.append(t)
            continue
        if len(run) >= least:
            spans.append((run[0].start(), run[-1].end(), k - len(run), len(run)))
        run = []
    return spans


def within(spans: list[tuple[int, int]]) -> Callable[[re.Match[str]], bool]:
    """Whether a match lies in one of ``spans``, which are in order and apart."""
    begins = [a for a, _ in spans]

    def inside(m: re.Match[str]) -> bool:
        i = bisect.bisect_right(begins, m.start()) - 1
        return i >= 0 and m.end() <= spans[i][1]

    return inside


def heading_runs(text: str, least: int = 3) -> list[tuple[int, int, int, int]]:
    """Runs of ``least`` or more neighbouring words in capitals."""
    return capital_runs(text, re.compile("[A-Z]{2,}"), least)


def _acronyms(text: str) -> str:
    inside = within([(a, b) for a, b, _, _ in heading_runs(text)])
    return re.sub(r"\b[A-Z]{2,5}\b", lambda m: m[0] if m[0] in WORD_ACRONYMS or inside(m) else " ".join(m[0]), text)


def roman_context(text: str, at: int) -> str | None:
    """What the word before place ``at`` makes of a Roman numeral there: ``regnal``, ``cardinal``, or nothing."""
    while at and text[at - 1].isspace():
        at -= 1
    end = at
    while at and text[at - 1].isascii() and text[at - 1].isalpha():
        at -= 1
    word = text[at:end]
    return "regnal" if word in ROMAN_REGNAL else "cardinal" if word in ROMAN_CARDINAL else None


def _roman(m: re.Match[str]) -> str:
    context = roman_context(m.string, m.start())
    n = roman(m[0]) if context else None
    if n is None:
        return m[0]
    return f"the {ordinal(n)}" if context == "regnal" else cardinal(n)


Say = str | Callable[[re.Match[str]], str]


def _keep(said: str | None, m: re.Match[str]) -> str:
    return m[0] if said is None else said


def _phone(m: re.Match[str]) -> str:
    plus = "plus " if m[0].startswith("+") else ""
    return plus + ", ".join(digits(g) for g in m.groups())


_MONTH = "|".join(sorted(MONTH_OF, key=len, reverse=True))
_YEAR = r"1\d{3}|20\d{2}"
_number = lambda s: int(s) if s else None

# fixed values: the patterns of the passes
#: The passes in the order in which they run: name, rules (pattern, flags, what is said).
PASSES: list[tuple[str, list[tuple[re.Pattern[str], Say]] | Callable[[str], str]]] = [
    ("metadata", [
        (re.compile(r"\bISBN(?:-1[03])?:?\s*[\d\-Xx ]{10,17}\b"), ""),
        (re.compile(r"\b(?:doi:|https?://(?:dx\.)?doi\.org/)[\w./()-]+", re.I), ""),
        (re.compile(r"©\s*\d{4}[^.\n]*"), ""),
        (re.compile(r"\bCC[ -]BY(?:-[A-Z]{2})?(?:[ -]\d(?:\.\d)?)?\b", re.I), ""),
        (re.compile(r"\bAll rights reserved\.?", re.I), ""),
    ]),
    ("quotes", lambda t: re.sub(r"\.{3,}", "…", re.sub(r"(?m)\s*\.{4,}\s*\d+\s*$", "", t.translate(PLAIN_SIGNS)))),
    ("urls", [
        (re.compile(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"), _address),
        (re.compile(r"\b(?:https?|ftp)://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+", re.I), _address),
        (re.compile(r"\bwww\.[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?:/[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*)?", re.I), _address),
    ]),
    ("abbreviations", [
        (re.compile(r"\bSt\.\s+([A-Z][a-zA-Z]+)"), lambda m: "Saint " + m[1]),
        (re.compile(r"\bSt\.(?!\s+[A-Z])"), "Street"),
        *[(re.compile(re.escape(a) if a.endswith(".") else rf"\b{a}\b"), said) for a, said in ABBREVIATIONS],
    ]),
    ("roman", [(re.compile(r"\b([IVXLCDM]+)\b"), _roman)]),
    ("acronyms", _acronyms),
    ("ordinals", [(re.compile(r"\b(\d+)(?:st|nd|rd|th)\b", re.I), lambda m: ordinal(int(m[1])))]),
    ("currency", [
        (re.compile(rf"([$£€¥₹₽])\s*({AMOUNT})(K|M|B|T)?\b"), lambda m: money(m[2], m[3], SYMBOLS[m[1]])),
        (re.compile(rf"\b({AMOUNT})(K|M|B|T)?\s+(USD|GBP|EUR|JPY|INR)\b"), lambda m: money(m[1], m[2], CODES[m[3]])),
    ]),
    ("units", [
        (re.compile(rf"\b({AMOUNT})\s*°\s*([CFK])\b"), lambda m: counted(m[1], DEGREES[m[2]])),
        (re.compile(rf"\b({AMOUNT})\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})\b", re.I), lambda m: counted(m[1], UNITS[m[2].lower()]) if m[2].lower() in UNITS else m[0]),
    ]),
    ("time", [(re.compile(r"\b([01]?\d|2[0-3]):([0-5]\d)\b"), lambda m: _time(int(m[1]), int(m[2])))]),
    ("dates", [
        (re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b"), lambda m: _keep(_date(int(m[3]), int(m[2]), int(m[1]), False), m)),
        (re.compile(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"), lambda m: _keep(_date(int(m[2]), int(m[1]), int(m[3]), False), m)),
        (re.compile(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({_MONTH})\.?(?:\s+(\d{{4}}))?\b", re.I), lambda m: _keep(_date(int(m[1]), MONTH_OF[m[2].lower()], _number(m[3]), True), m)),
        (re.compile(rf"\b({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*,?\s*(\d{{4}}))?\b", re.I), lambda m: _keep(_date(int(m[2]), MONTH_OF[m[1].lower()], _number(m[3]), False), m)),
    ]),
    ("phones", [
        (re.compile(r"(?<!\d)\+(\d{1,3})[-\s](\d{3})[-\s](\d{3})[-\s](\d{4})(?!\d)"), _phone),
        (re.compile(r"(?<!\d)(1)[-\s](\d{3})[-\s](\d{3})[-\s](\d{4})(?!\d)"), _phone),
        (re.compile(r"(?<!\d)\((\d{3})\)\s*(\d{3})[-\s](\d{4})(?!\d)"), _phone),
        (re.compile(r"(?<!\d)(\d{3})[-\s](\d{3})[-\s](\d{4})(?!\d)"), _phone),
    ]),
    ("years", [
        (re.compile(rf"\b({_YEAR})\s*[–\-]\s*({_YEAR})\b"), lambda m: f"{year(int(m[1]))} to {year(int(m[2]))}"),
        (re.compile(rf"\b({_YEAR})s\b"), lambda m: decade(int(m[1]))),
        (re.compile(r"'(\d{2})s\b"), lambda m: PLURAL_TENS.get(cardinal(int(m[1])), cardinal(int(m[1])) + "s") if int(m[1]) % 10 == 0 else m[0]),
        (re.compile(rf"\b(in|by|of|since|until|from|to|around|circa|ca\.?|c\.|during|after|before|between)\s+({_YEAR})\b", re.I), lambda m: f"{m[1]} {year(int(m[2]))}"),
    ]),
    ("fractions", [(re.compile(r"\b(\d+)/(\d+)\b"), lambda m: m[0] if int(m[2]) == 0 else f"{cardinal(int(m[1]))} {DENOMINATORS.get(int(m[2])) or ordinal(int(m[2]))}{'' if int(m[1]) == 1 else 's'}")]),
    ("decimals", [(re.compile(r"(?<!\d)(-?)(\d+)\.(\d+)(?!\d)"), lambda m: f"{'minus ' if m[1] else ''}{cardinal(int(m[2]))} point {digits(m[3])}")]),
    ("cardinals", [(re.compile(r"(?<![\d.])-?\d{1,3}(?:,\d{3})+(?![\d.])|(?<![\d.])-?\d+(?![\d.])"), lambda m: cardinal(int(m[0].replace(",", ""))))]),
    ("periods", [(re.compile(r"\s+\."), ".")]),
    ("blanks", lambda t: re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()),
]
_BY_NAME = dict(PASSES)
#: What a text must hold for a pass to find anything: most texts skip most passes at the price of one look.
_NEEDS = {"urls": re.compile(r"@|://|www\.", re.I), "metadata": re.compile(r"ISBN|doi|©|CC[ -]|rights", re.I), "abbreviations": re.compile(r"\.|vs"), "acronyms": re.compile("[A-Z]{2}"), "roman": re.compile(r"\b[IVXLCDM]+\b")}
_NEEDS |= dict.fromkeys(("ordinals", "currency", "units", "time", "dates", "phones", "years", "fractions", "decimals", "cardinals"), re.compile(r"\d"))
#: Abbreviations that end with a period are found as they stand, wherever they stand.
_LITERAL = {re.compile(re.escape(a)).pattern: a for a, _ in ABBREVIATIONS if a.endswith(".")}


def run_pass(name: str, text: str) -> str:
    rules, need = _BY_NAME[name], _NEEDS.get(name)
    if need is not None and need.search(text) is None:
        return text
    if callable(rules):
        return rules(text)
    for pattern, say in rules:
        if isinstance(say, str) and pattern.pattern in _LITERAL:
            text = text.replace(_LITERAL[pattern.pattern], say)
        else:
            text = pattern.sub((lambda _, s=say: s) if isinstance(say, str) else say, text)
    return text


def normalize(text: str) -> str:
    """All passes in order; an empty text stays as it is."""
    if text:
        for name, _ in PASSES:
            text = run_pass(name, text)
    return text
