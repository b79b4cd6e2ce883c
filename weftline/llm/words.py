"""Vectorised words of Arrow text batches.

A word is a run of bytes other than space and 0x09-0x0D; its hash ignores the case of A-Z. Texts are taken
whole, in chunks of about a megabyte or of one longer text, so a task's memory doesn't depend on its batch. A longer text is hashed in pieces;
its words are held together, some 33 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: For models of words: all ASCII but letters and digits is blank.
_SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A fixed random value for each byte, and an odd base: hashes agree in every process.
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POW: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = max(n, CHUNK + 4096)
        for i, base in enumerate((_BASE, _BACK)):
            p = np.full(m, base, dtype=np.uint64)
            p[0] = 1
            _POW[i] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words(NamedTuple):
    """Words of a chunk: ``doc`` is the row in the chunk, ``first[i]:first[i+1]`` are row i's words."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


class Chunk(NamedTuple):
    """Rows ``lo`` to ``hi`` of a batch: their bytes end to end, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray


def chunks(column: pa.Array, most: int = CHUNK, most_rows: int = 1 << 16) -> Iterator[Chunk]:
    """Runs of rows of about ``most`` bytes, at least one row each; null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        hi = min(hi, len(column), lo + most_rows)
        yield Chunk(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def _piece(data: np.ndarray, begins: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``data``; a word also ends where a row begins."""
    word = ~blank[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[begins[begins <= len(data)]] = True
    edge[0] = edge[len(data)] = True
    start = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1])) | edge[:-1]))
    end = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | edge[1:])) + 1
    up, down = _powers(len(data))
    run = np.concatenate((np.zeros(1, dtype=np.uint64), np.add.accumulate(_BYTE[_LOWER[data]] * up)))
    return start, end, mix64((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def words(chunk: Chunk, *, signs: bool = False) -> Words:
    """Words of the rows of a chunk; with ``signs`` ASCII punctuation separates words too."""
    data, at, blank_of = chunk.data, chunk.at, _SIGNS if signs else _BLANK
    if len(data) <= 4 * CHUNK:
        start, end, h = _piece(data, at, blank_of) if len(data) else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    else:  # one very long text: pieces that end at a blank
        got, lo = [], 0
        while lo < len(data):
            hi = min(len(data), lo + CHUNK)
            while hi < len(data):
                blank = np.flatnonzero(blank_of[data[hi : hi + CHUNK]])
                if len(blank):
                    hi += int(blank[0])
                    break
                hi = min(len(data), hi + CHUNK)
            s, e, h = _piece(data[lo:hi], at[(at >= lo) & (at <= hi)] - lo, blank_of)
            got.append((s + lo, e + lo, h))
            lo = hi
        start, end, h = (np.concatenate(x) for x in zip(*got, strict=True))
    first = np.searchsorted(start, at, side="left")
    doc = np.repeat(np.arange(chunk.hi - chunk.lo), np.diff(first))
    return Words(doc, h, start, end, first)


def shingles(w: Words, n: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct ``n``-word hashes; a text of fewer words has its whole sequence as one."""
    k = len(w.hash)
    mult = mix64(np.arange(1, n + 1, dtype=np.uint64)) | _U(1)
    rolled = np.zeros(max(0, k - n + 1), dtype=np.uint64)
    for j in range(n):
        rolled += w.hash[j : j + len(rolled)] * mult[j]
    rolled = mix64(rolled)
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if hi - lo >= n:
            yield np.unique(rolled[lo : hi - n + 1])
        elif hi > lo:
            h = np.zeros(1, dtype=np.uint64)
            for j in range(hi - lo):
                h = mix64(h + w.hash[lo + j : lo + j + 1] * mult[j])
            yield mix64(h + _U(hi - lo))
        else:
            yield np.zeros(0, dtype=np.uint64)
