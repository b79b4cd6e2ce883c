"""Column functions of the projections: pure expressions, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# fixed values: tiers by seconds of speech
FULL_S, REDUCED_S, FEW_S = 1800, 600, 60
# fixed values: speech rates (characters a second), speed of engines (audio a wall second)
RATES = {"fi": 20.0, "en": 22.5}
SPEED = {"edge": 5.0, "piper": 6.0, "chatterbox_fi": 0.85, "voxcpm2": 1.0}
GPU_ONLY, CPU_PENALTY, OTHER_SPEED = ("chatterbox_fi", "voxcpm2"), 20.0, 2.0
BYTES_PER_CHAR, OTHER_BYTES = {"edge": 520, "piper": 6000, "chatterbox_fi": 8000}, 2000
EMOTION_NAMES = {"ang": "angry", "hap": "happy", "sad": "sad", "neu": "neutral"}


def quality_tier(seconds: Column) -> Column:
    return F.when(seconds >= FULL_S, "full_lora").when(seconds >= REDUCED_S, "reduced_lora").when(seconds >= FEW_S, "few_shot").otherwise("skip")


def lookup(values: dict, key: Column, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def is_prose(text: Column, least: int = 3000, most_dots: float = 0.05, most_single: float = 0.2) -> Column:
    """Long enough, few dots, and few one-letter words at its start."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    found = F.filter(F.split(F.substring(t, 1, 500), r"(?U)\s+"), lambda w: w != "")
    single = F.size(F.filter(found, lambda w: (F.length(w) == 1) & w.rlike(r"^\p{L}$")))
    return (F.length(t) >= least) & (dots / F.greatest(F.length(t), F.lit(1)) <= most_dots) & (F.size(found) > 0) & (single / F.greatest(F.size(found), F.lit(1)) <= most_single)


def text_penalties(text: Column, least: int = 6, most: int = 80) -> Column:
    """Tags of text that makes a poor reference clip."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.array_compact(F.array(F.when(text.rlike(r"\d"), "digits"), F.when(text.rlike("[A-ZÄÖÅ]{3,}"), "acronym"), F.when(n < least, "too_few_words").when(n > most, "too_many_words")))


def asr_confidence(logprob: Column) -> Column:
    return F.when(logprob.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + logprob)))


def estimate_audio(chars: Column, lang: Column) -> Column:
    return F.when(chars <= 0, 0.0).otherwise(chars / lookup(RATES, lang, RATES["fi"]))


def estimate_wall(audio: Column, engine: Column, has_gpu: Column) -> Column:
    wall = audio / lookup(SPEED, engine, OTHER_SPEED)
    return F.when(audio <= 0, 0.0).otherwise(wall * F.when(engine.isin(*GPU_ONLY) & ~has_gpu, CPU_PENALTY).otherwise(1.0))


def format_duration(s: Column) -> Column:
    """45 s, 12 min 34 s, 1 h 23 min; halves go to the even number, 60 carries."""
    text = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x), b.cast("string"), F.lit(y))
    m, h = F.floor(s / 60), F.floor(s / 3600)
    rs, rm = F.bround(s - m * 60).cast("long"), F.bround((s - h * 3600) / 60).cast("long")
    minutes = F.when(rs == 60, text(m + 1, " min ", F.lit(0), " s")).otherwise(text(m, " min ", rs, " s"))
    hours = F.when(rm == 60, text(h + 1, " h ", F.lit(0), " min")).otherwise(text(h, " h ", rm, " min"))
    return F.when(s.isNull(), "?").when(s <= 0, "0 s").when(s < 60, F.concat(F.bround(s).cast("long").cast("string"), F.lit(" s"))).when(s < 3600, minutes).otherwise(hours)


def format_hms(s: Column) -> Column:
    """45s, 3m07s, 1h05m."""
    n = F.floor(s).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).when(n < 3600, F.concat(F.floor(n / 60).cast("string"), F.lit("m"), two(n % 60), F.lit("s"))).otherwise(F.concat(F.floor(n / 3600).cast("string"), F.lit("h"), two(F.floor(n / 60) % 60), F.lit("m")))


def parse_hms(text: Column) -> Column:
    pattern = r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?$"
    part = lambda i: F.coalesce(F.regexp_extract(F.trim(text), pattern, i).try_cast("bigint"), F.lit(0))
    return part(1) * 3600 + part(2) * 60 + part(3)


def format_age(s: Column) -> Column:
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s ago")).when(s < 3600, unit(60, "m ago")).when(s < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def version_key(text: Column) -> Column:
    """Numbers of a version, for comparison; junk is 0."""
    return F.transform(F.split(F.regexp_replace(text, "^[vV]+", ""), r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def char_label(n: Column) -> Column:
    """0 A, 25 Z, 26 AA, 27 AB: numbers in base 26 without a zero, to two letters."""
    one = lambda c: F.char((F.lit(65) + c).cast("int"))
    return F.when(n < 26, one(n)).otherwise(F.concat(one(F.floor(n / 26) - 1), one(n % 26)))


def description_prefix(text: Column) -> Column:
    """A voice's description in parentheses, to stand before a text: one outer pair that is there already is not doubled; blank ones say nothing."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    t = strip(F.coalesce(text, F.lit("")))
    inner = F.when(t.startswith("(") & t.endswith(")"), strip(F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))))).otherwise(t)
    return F.when(inner == "", "").otherwise(F.concat(F.lit("("), inner, F.lit(")")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def sentence_start(text: Column) -> Column:
    """The text from its first sentence that begins with a capital, unless it begins with one."""
    begin = F.regexp_extract(text, r"(?s)[.!?…]\s+([A-ZÅÄÖ].*)$", 1)
    return F.when(text.rlike(r"""^[\p{Lu}"'(«]"""), text).when(begin != "", begin).otherwise(text)


def sample_text(text: Column, most: int = 500) -> Column:
    """The first ``most`` characters, cut after the last sentence end that lies beyond a fifth of them."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    head = F.substring(t, 1, most)
    back = F.reverse(head)
    ends = [e + after for e in ".!?" for after in " \n"]
    # length up to the last end: what is left of it in the reversed text
    upto = F.greatest(*[F.when(F.locate(e[::-1], back) > 0, F.length(head) - F.locate(e[::-1], back)).otherwise(0) for e in ends])
    cut = F.when(upto - 1 >= most // 5, F.substring(head, F.lit(1), upto)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.regexp_replace(cut, r"(?U)\s+$", ""))
