"""Hashed byte and word features of text chunks, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import Chunk, words

#: ASCII other than letters becomes one blank, A-Z lose their case.
_FOLD = np.array([(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32) if b < 128 else b for b in range(256)], dtype=np.uint8)


#: Bytes that are counted at a time: a text of any length takes some 40 times as much at most.
PIECE = 1 << 20


def byte_grams(c: Chunk, dims: int, *, fold: bool = True, sizes: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Counts (rows x dims) of the hashed byte n-grams within each row; ``dims`` is a power of two.
    The caller bounds the rows of a chunk; its bytes are counted in pieces that overlap by a gram less one byte."""
    rows = c.hi - c.lo
    out = np.zeros(rows * dims, dtype=np.int64)
    shift = np.uint32(32 - dims.bit_length() + 1)
    for lo in range(0, len(c.data), PIECE):
        raw = c.data[lo : lo + PIECE + max(sizes) - 1]
        data = (_FOLD[raw] if fold else raw).astype(np.uint32)
        row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(np.clip(c.at, lo, lo + len(data))))
        for n in sizes:
            begins = min(PIECE, len(data) - n + 1)
            if begins <= 0:
                continue
            code = np.zeros(begins, dtype=np.uint32)
            for j in range(n):
                code = code * np.uint32(257) + data[j : j + begins] + np.uint32(1)
            keep = row[:begins] == row[n - 1 : n - 1 + begins]
            cell = ((code * np.uint32(2654435761)) >> shift).astype(np.int64) + row[:begins] * dims
            out += np.bincount(cell[keep], minlength=rows * dims)
    return out.reshape(rows, dims)


def word_counts(c: Chunk, dims: int) -> np.ndarray:
    """Counts (rows x dims) of hashed words."""
    w = words(c, signs=True)
    rows = c.hi - c.lo
    cell = (w.hash % np.uint64(dims)).astype(np.int64) + w.doc * dims
    return np.bincount(cell, minlength=rows * dims).reshape(rows, dims)


def fold_of(doc_id: Column, ways: int) -> Column:
    """crc32 of the id as text, modulo ``ways``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(ways))


def bounded_sample(rows: DataFrame, key: str, most: int, *, by: str | None = None, seed: int = 5) -> DataFrame:
    """About ``most`` rows at most, the same ones in every run; with ``by`` each value has an equal share.
    This is for fitting classifiers only; ``most`` is their documented parameter."""
    unit = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)
    if by is None:
        n = rows.count()
        return rows.where(unit < most / max(n, 1))
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    if not counts:
        return rows.limit(0)
    each = most / len(counts)
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    return rows.where(unit < F.coalesce(F.try_element_at(rate, F.col(by)), F.lit(0.0)))
