"""The Jaccard join and connected components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm.components import components
from weftline.llm.ngram_join import near_groups
from weftline.llm.words import chunks, shingles, words

from .conftest import COLUMNS, prose, rows_of


def _set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=4, percent=85):
    sets = [_set(t, n) for _, t in rows]
    name = list(range(len(rows)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                name[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted((str(d), len(sets[i]), str(low.get(top(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def _same(df, rows):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in near_groups(df).collect())
    assert got == brute(rows)


def _edited(words_, rng, k):
    w = list(words_)
    for _ in range(k):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [w[i], "new" + str(rng.randint(0, 9))], [str(rng.randint(0, 99))]])
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    rng = random.Random(seed)
    texts = []
    for g in range(12):
        base = prose(seed * 100 + g, rng.choice([3, 6, 12, 40, 150])).split()
        texts += [_edited(base, rng, rng.choice([0, 0, 1, 2, 4])) for _ in range(rng.randint(1, 9))]
    passage = prose(999, 30)
    texts += [f"{prose(5000 + i, rng.randint(5, 80))} {passage} {prose(6000 + i, 10)}" for i in range(60)]
    big = prose(77, 120).split()
    texts += [_edited(big, rng, rng.randint(0, 5)) for _ in range(50)]
    rng.shuffle(texts)
    df = spark.createDataFrame(rows_of(texts), COLUMNS).repartition(4)
    _same(df, list(enumerate(texts)))


def test_odd(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _same(odd, rows)
    assert near_groups(nothing).count() == 0


def test_threshold_is_exact(spark):
    """Sets of 20 and 17 shingles, all shared: exactly 85 percent."""
    w = prose(5, 23).split()
    texts = [" ".join(w), " ".join(w[:20]), " ".join(w[:19])]
    _same(spark.createDataFrame(rows_of(texts), COLUMNS), list(enumerate(texts)))


def test_components(spark):
    rng = random.Random(2)
    e = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    name = {}

    def top(i):
        name.setdefault(i, i)
        while name[i] != i:
            i = name[i]
        return i

    for a, b in e:
        x, y = sorted((top(a), top(b)))
        name[y] = x
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    used = {v for a, b in e if a != b for v in (a, b)}
    assert got == {v: top(v) for v in used}


def test_words_of_chunks_and_pieces():
    """A text hashes alike alone, among others, and in pieces when it is very long."""
    long = prose(9, 900_000)
    col = pa.array(["a b", None, "", long, "Ä  b\tC\n"])
    all_ = [s for c in chunks(col, 1 << 16) for s in shingles(words(c), 2)]
    assert [len(s) for s in all_[:3]] == [1, 0, 0] and len(all_) == 5
    alone = next(shingles(words(next(chunks(pa.array([long]), 1 << 30))), 2))
    assert np.array_equal(alone, all_[3])
    assert np.array_equal(next(shingles(words(next(chunks(pa.array(["Ä b c"])))), 2)), all_[4])


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_groups_around_the_threshold(spark, seed):
    """Copies whose likeness to their origin lies on both sides of the threshold, two variants of a text, shared edits, and cut texts."""
    rng = random.Random(seed)
    base = prose(seed * 7, 160).split()
    other = base[:]
    for i in range(20, 30):
        other[i * 5] = f"variant{i}"
    texts = [_edited(base, rng, rng.randint(0, 9)) for _ in range(70)] + [_edited(other, rng, rng.randint(0, 7)) for _ in range(50)]
    texts += [" ".join(base[: rng.randint(90, 160)]) for _ in range(25)]
    edits = [_edited(base, rng, 6).split() for _ in range(4)]
    texts += [_edited(rng.choice(edits), rng, rng.randint(0, 5)) for _ in range(50)]
    small = prose(seed * 7 + 1, 14).split()
    texts += [_edited(small, rng, rng.randint(0, 2)) for _ in range(30)]
    rng.shuffle(texts)
    _same(spark.createDataFrame(rows_of(texts), COLUMNS).repartition(3), list(enumerate(texts)))
