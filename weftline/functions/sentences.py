"""Sentences and chunks of prose: pure functions, to run inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Words whose period doesn't end a sentence.
ABBREVIATIONS = frozenset(
    "esim ks mm ym yms n s v ts eli nk ns ko ao ed jne tms vrt huom mr mrs prof tri fil dos toim "
    "etc ie eg ms dr vs cf no vol pp p ch fig al".split()
)
MAX_CHARS = 3000

#: Candidates for an end: marks that end hard (with any that follow), an ellipsis, or one period.
_END = re.compile(r"[!?…。][!?….]*|\.\.\.|\.")
_OPENERS = "\"'«("
_BLANKS = re.compile(r"\s*")
_LONGEST = max(map(len, ABBREVIATIONS))


def _word_before(text: str, start: int, end: int) -> str:
    """The word that ends at ``end``, in lower case; of one that is longer than any abbreviation a part that is none."""
    piece = text[max(start, end - _LONGEST - 1) : end]
    return re.split(r"\s", piece)[-1].lower()


def split_sentences(text: str) -> list[str]:
    """Sentences with their marks. Each candidate mark is judged by the word before and the sign after it; only places move, nothing is copied
    but the sentences."""
    out, start, at, n = [], 0, 0, len(text)
    while (m := _END.search(text, at)) is not None:
        end = at = m.end()
        follows = _BLANKS.match(text, end).end()
        if end < n and follows == end:
            continue  # no blank after it: 5.2, example.com
        if m[0] == ".":
            word = _word_before(text, start, m.start())
            if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()):
                continue
            if follows < n and not (text[follows].isupper() or text[follows].isdigit() or text[follows] in _OPENERS):
                continue
        out.append(text[start:end])
        start = at = follows
        if follows >= n:
            break
    if text[start:].strip():
        out.append(text[start:])
    return out


def _pack(pieces: list[str], most: int) -> list[str]:
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + len(p) + 1 <= most:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def force_split(text: str, most: int) -> list[str]:
    """Words packed up to ``most`` characters; a longer word stands alone."""
    return _pack(text.split(), most)


def pack_sentences(sentences: Iterable[str], most: int) -> list[str]:
    """Sentences packed into chunks of at most ``most`` characters; a longer sentence is split by words, and its chunks
    take nothing from their neighbours."""
    out: list[str] = []
    held: list[str] = []
    for s in sentences:
        if len(s) > most:
            out += _pack(held, most) + force_split(s, most)
            held = []
        elif s:
            held.append(s)
    return out + _pack(held, most)


def chunk_text(text: str | None, most: int = MAX_CHARS) -> list[str]:
    """A text's sentences, trimmed and packed."""
    return pack_sentences((x.strip() for x in split_sentences(text or "")), most)
