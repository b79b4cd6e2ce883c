"""Likeness of short texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher
from heapq import heappop, heappush

import numpy as np

#: Texts from this length on have popular characters, which begin no match (a rule of ``difflib``).
POPULAR_FROM = 200
#: Columns of character counts; characters beyond share them.
BINS = 64
#: Pairs of characters up to which a comparison is a grid of bits.
GRID = 1 << 18
#: Grids and texts with holes that are kept at a time.
KEPT = 16384
#: Stands for a popular character.
_HOLE = "\U0010ffff"


def _holes(b: str) -> str:
    """``b`` with holes for its popular characters; ``b`` itself where it has none."""
    if len(b) < POPULAR_FROM:
        return b
    popular = [c for c, n in Counter(b).items() if n > len(b) // 100 + 1]
    return b.translate({ord(c): _HOLE for c in popular}) if popular else b


def _rows(holes: str) -> dict[str, bytes]:
    """For each character the bits of its places in ``holes``, and at least one bit more."""
    places: dict[str, int] = {}
    for j, c in enumerate(holes):
        places[c] = places.get(c, 0) | 1 << j
    places.pop(_HOLE, None)
    return {c: x.to_bytes(len(holes) // 8 + 1, "little") for c, x in places.items()}


def _run_by_bits(grid: bytes, width: int, alo: int, ahi: int, blo: int, bhi: int, whole: bool) -> tuple[int, int, int]:
    """The longest diagonal of set bits within rows [alo, ahi) and columns [blo, bhi), the first row and then the first column of equals: row, column, length."""
    s = int.from_bytes(grid[alo * width : ahi * width], "little")
    if not whole:
        s &= int.from_bytes(((1 << bhi) - (1 << blo)).to_bytes(width, "little") * (ahi - alo), "little")
    if not s:
        return alo, blo, 0
    step, size, twos = width * 8 + 1, 1, [s]
    while t := s & (s >> size * step):
        twos.append(s := t)
        size *= 2
    for k in range(len(twos) - 2, -1, -1):
        if t := s & (twos[k] >> size * step):
            s, size = t, size + (1 << k)
    x, y = divmod((s & -s).bit_length() - 1, width * 8)
    return alo + x, y, size


def _run_by_search(a: str, holes: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The same of the texts themselves, for those whose grid is too large."""
    i, x, y, size = alo, alo, blo, 0
    while i + size < ahi:
        j = holes.find(a[i : i + size + 1], blo, bhi)
        while j >= 0:
            x, y, size = i, j, size + 1
            if i + size >= ahi:
                break
            j = holes.find(a[i : i + size + 1], j, bhi)
        i += 1
    return x, y, size


def matched(a: str, b: str, holes: str, rows: dict[str, bytes] | None, most: int, least: float = 0.0) -> int:
    """Characters that ``SequenceMatcher(None, a, b)`` matches: the longest common run, the earliest in ``a`` and then in ``b``, and the same left and right of it.
    -1 as soon as it is certain that they are fewer than ``least``. ``holes`` and ``rows`` are of ``b`` (``rows`` is None for large texts), and no more than ``most`` can match."""
    total, possible, left, la, lb = 0, most, [(-most, 0, len(a), 0, len(b))], len(a), len(b)
    if rows is not None:
        width, none = lb // 8 + 1, bytes(lb // 8 + 1)
        grid = b"".join([rows.get(c, none) for c in a])
    while left:
        # the largest part first: what it loses settles most
        part, alo, ahi, blo, bhi = heappop(left)
        possible += part
        x, y, size = _run_by_search(a, holes, alo, ahi, blo, bhi) if rows is None else _run_by_bits(grid, width, alo, ahi, blo, bhi, bhi - blo == lb)
        if holes is not b:
            while x > alo and y > blo and a[x - 1] == b[y - 1]:
                x, y, size = x - 1, y - 1, size + 1
            while x + size < ahi and y + size < bhi and a[x + size] == b[y + size]:
                size += 1
        if size:
            total += size
            possible += size
            if n := min(x - alo, y - blo):
                heappush(left, (-n, alo, x, blo, y))
                possible += n
            x, y = x + size, y + size
            if n := min(ahi - x, bhi - y):
                heappush(left, (-n, x, ahi, y, bhi))
                possible += n
        if possible < least:
            return -1
    return total


class Candidates:
    """Texts to find the likest of, case and outer blanks aside. Common characters bound a ratio from above, so few are compared in full."""

    def __init__(self, texts: Sequence[str | None]) -> None:
        self.texts = [(t or "").strip().lower() for t in texts]
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.kept: dict[str, tuple[str, dict[str, bytes] | None]] = {}
        codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.codes, place = np.unique(codes, return_inverse=True)
        rows = np.repeat(np.arange(len(self.texts)), self.sizes)
        self.bins = min(BINS, max(1, len(self.codes)))
        counts = np.bincount(rows * self.bins + place % self.bins, minlength=len(self.texts) * self.bins)
        self.counts = counts.reshape(len(self.texts), self.bins).astype(np.uint16 if not len(self.sizes) or self.sizes.max() < 65536 else np.int64)

    def __len__(self) -> int:
        return len(self.texts)

    def bounds(self, wanted: str, lo: int, hi: int) -> np.ndarray:
        """The most that the ratio of each of [lo, hi) can be."""
        codes = np.frombuffer(wanted.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        place = np.searchsorted(self.codes, codes)
        known = self.codes[np.minimum(place, len(self.codes) - 1)] == codes if len(self.codes) else np.zeros(len(codes), dtype=bool)
        mine = np.bincount(place[known] % self.bins, minlength=self.bins)
        top = 65535 if self.counts.dtype == np.uint16 else len(wanted)
        both = np.minimum(self.counts[lo:hi], np.minimum(mine, top).astype(self.counts.dtype)).sum(axis=1, dtype=np.int64)
        return 2.0 * both / (self.sizes[lo:hi] + len(wanted))

    def best(self, text: str | None, lo: int = 0, hi: int | None = None, best: tuple[int, float] = (-1, 0.0)) -> tuple[int, float]:
        """Place and ratio of the likest text of [lo, hi), the first of equals, if it is liker than ``best``; (-1, 0) without any likeness."""
        wanted = (text or "").strip().lower()
        hi = len(self.texts) if hi is None else min(hi, len(self.texts))
        if not wanted or lo >= hi:
            return best
        found, ratio = best
        most = self.bounds(wanted, lo, hi)
        seen: dict[str, float] = {}
        for i in np.argsort(-most, kind="stable").tolist():
            bound = most[i]
            if bound < ratio or bound == 0.0:
                break
            i += lo
            if bound == ratio and i > found:
                continue
            c = self.texts[i]
            r = seen.get(c)
            if r is None:
                r = seen[c] = self._ratio(wanted, i, bound, ratio)
            if r > 0.0 and (r > ratio or (r == ratio and i < found)):
                found, ratio = i, r
        return found, ratio

    def _ratio(self, wanted: str, i: int, bound: float, least: float) -> float:
        """The ratio of a text, or -1 if it is below ``least``."""
        c = self.texts[i]
        if _HOLE in wanted or _HOLE in c:
            return SequenceMatcher(None, wanted, c).ratio()
        kept = self.kept.get(c)
        if kept is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            holes = _holes(c)
            kept = self.kept[c] = (holes, _rows(holes) if len(c) ** 2 <= GRID else None)
        holes, rows = kept
        length = len(wanted) + len(c)
        n = matched(wanted, c, holes, rows if len(wanted) * len(c) <= GRID else None, round(bound * length / 2), least * length / 2 - 1e-6)
        return 2.0 * n / length if n >= 0 else -1.0


def best_match(text: str | None, candidates: Sequence[str]) -> tuple[int, float]:
    """Place and ratio of the likest candidate, case and outer blanks aside; (-1, 0) without any likeness."""
    return Candidates(candidates).best(text)
