"""Nearest neighbours and decontamination against brute force."""

import random

import numpy as np
import pytest

from weftline.llm import ann, decontam

from .conftest import COLUMNS, prose, rows_of

VEC = "vec_id long, embedding array<float>, label int, v string, q int, b int"


def _frame(spark, ids, x):
    return spark.createDataFrame([(i, None if r is None else [None if v is None else float(v) for v in r], 0, "", 0, 0) for i, r in zip(ids, x, strict=True)], VEC).repartition(3)


def _brute(ids, x, k=20):
    x = np.array([np.float32(r) for r in x], dtype=np.float64)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = np.multiply(x, q).sum(axis=1)
            own = next(n for n, (j, y) in enumerate(zip(ids, x, strict=True)) if j == i and (y == q).all())
            order = sorted((-v, j) for n, (v, j) in enumerate(zip(s, ids, strict=True)) if n != own)[:k]
            out[i] = [(j, -v) for v, j in order]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24))
    if scale:
        x *= rng.uniform(0.2, 3, (3000, 1))
    ids = list(range(3000))
    got: dict[int, list] = {}
    for r in ann.search(_frame(spark, ids, x), block_rows=800, block_queries=64).collect():
        got.setdefault(r["query_id"], []).append(r)
    want = _brute(ids, x)
    assert set(got) == set(want)
    hits = sum(len({r["vec_id"] for r in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits / (20 * len(want)) >= 0.9
    for i, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        assert all(abs(r["score"] - float(np.dot(np.float32(x[i]).astype(float), np.float32(x[r["vec_id"]]).astype(float)))) < 1e-9 for r in rows)


def test_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (4000, 32), dtype=np.uint8)
    codes[:2000, :] = codes[0] ^ (rng.random((2000, 32)) < 0.15).astype(np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 17, 31, 33, 64, 100, 128, 256):
        for q in (0, 1999, 3000):
            far = np.bitwise_count(codes ^ codes[q]).astype(int).sum(axis=1)
            assert np.array_equal(index.within(codes[q], radius, most=2.0), np.flatnonzero(far <= radius))
            assert np.array_equal(index.within(codes[q], radius), np.flatnonzero(far <= radius))


def test_odd_vectors(spark):
    ids = [0, 20, 1, 2, 3, 4, 5, None, 40]
    x = [[1, 0], [1, 0], [1, 0], None, [0, 0], [float("nan"), 1], [1, None], [0.5, 0], [1, 2, 3]]
    got = ann.search(_frame(spark, ids, x)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got if r["vec_id"] != -1} == {(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)}
    assert ann.search(_frame(spark, [], [])).count() == 0
    assert ann.search(_frame(spark, [1, 2], [[1.0, 0], [0, 1.0]])).count() == 0


def test_equal_vectors_in_order_of_id(spark):
    ids = list(range(100))
    got = ann.search(_frame(spark, ids, [[0.6, 0.8]] * 100), k=5).collect()
    rows = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0)
    assert rows == [(i, i) for i in range(1, 6)]


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(3)
    items = [prose(9000 + i, rng.randint(14, 60)) for i in range(40)]
    texts, truth = [], {}
    for i in range(600):
        w = prose(i, rng.randint(30, 200))
        if i % 10 == 0:
            item = rng.randrange(40)
            t = items[item].split()
            if i % 20 == 0:  # a paraphrase: some words replaced, some added
                t = [x if rng.random() > 0.15 else "other" for x in t]
                t.insert(len(t) // 2, "indeed")
            at = rng.randint(0, len(w))
            w = w[:at] + " " + " ".join(t).upper() + " " + w[at:]
            truth[i] = item
        texts.append(w)
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)] + [(90, None, 0), (91, "", 0), (None, "x", 0)], "item_id long, text string, hits int")
    return spark.createDataFrame(rows_of(texts), COLUMNS).repartition(3), bench, truth


def test_leaks_are_found(leaks, odd, nothing):
    docs, bench, truth = leaks
    model = decontam.fit(docs, bench)
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontam.matches(docs, model).collect()}
    assert len(got) == 600
    assert {i for i, h in got.items() if h} == set(truth)
    assert all(truth[i] in h for i, h in got.items() if h)
    out = decontam.matches(odd, model)
    assert out.count() == odd.count() and not any(r["hits"] for r in out.collect())
    assert decontam.matches(nothing, model).count() == 0
    assert not any(r["hits"] for r in decontam.matches(docs, decontam.fit(docs, bench.limit(0))).collect())


def _brute_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_lcs():
    rng = random.Random(6)
    for _ in range(200):
        a = np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 30))])
        b = np.array([rng.randint(0, 6) for _ in range(rng.randint(0, 60))])
        n, f, e = decontam.lcs(a, b)
        assert n == _brute_lcs(a.tolist(), b.tolist())
        if n:
            assert _brute_lcs(a.tolist(), b[f:e].tolist()) == n


def _hits(spark, texts, items):
    docs = spark.createDataFrame(rows_of(texts), COLUMNS)
    model = decontam.fit(docs, spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, hits int"))
    return {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontam.matches(docs, model).collect()}


def test_a_copy_behind_nearer_partial_quotes(spark):
    item = prose(501, 59, "aeinorst").split()
    other = [prose(510 + i, 160, "bcdfghjk") for i in range(6)]
    far = [x if i % 4 else "zz" for i, x in enumerate(item)]
    text = " ".join([other[0], *[" ".join([*item[:24], other[i]]) for i in range(1, 5)], *far, other[5]])
    partial = " ".join([other[0], *item[:24], other[1]])
    assert _hits(spark, [text, partial, *other], [" ".join(item)]) == {0: [0], 1: [], **{i: [] for i in range(2, 8)}}


def test_stray_words_of_the_item_around_a_copy(spark):
    item = prose(601, 20, "aeinorst").split()
    other = [prose(610 + i, 60, "bcdfghjk").split() for i in range(4)]
    text = [*other[0], item[0], item[1], *other[1][:12], *item[2:-2], *other[2][:12], item[-2], item[-1], *other[3]]
    assert _hits(spark, [" ".join(text), *[" ".join(o) for o in other]], [" ".join(item)]) == {0: [0], 1: [], 2: [], 3: [], 4: []}


def test_bounded_subsequences_are_the_longest():
    rng = random.Random(8)
    rule = {"ratio": 0.6, "answer_ratio": 0.5, "answer_words": 5}
    for _ in range(300):
        a = np.array([rng.randint(0, 9) for _ in range(rng.randint(3, 14))])
        b = np.array([rng.randint(0, 30) for _ in range(rng.randint(0, 90))])
        most, best = int(1.6 * len(a) + 4), 0
        for s in range(len(b)):
            n, f, e = decontam.lcs(a, b[s : s + most])
            tail = a[-min(5, len(a)) :]
            if n >= 0.6 * len(a) or (n >= 0.5 * len(a) and _brute_lcs(tail.tolist(), b[s + f : s + e].tolist()) >= 0.8 * len(tail)):
                best = max(best, n)
        got = decontam.closest(a, b, [j for j in range(len(b)) if b[j] in a], **rule)
        assert (got[0] if got else 0) == best
        if got:
            assert got[3] - got[2] <= most and _brute_lcs(a.tolist(), b[got[2] : got[3]].tolist()) == best


def test_repeated_queries_have_whole_answers_each(spark):
    rng = np.random.default_rng(9)
    ids = [0, 0, 0, *range(1, 21)]
    x = rng.standard_normal((21, 8))
    x = [x[i] for i in ids]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(_frame(spark, ids, x)).collect()]
    want = _brute(ids, x)
    assert sorted(g for g in got if g[0] == 0) == sorted((0, n + 1, j) for _ in range(3) for n, (j, _) in enumerate(want[0]))
    assert sorted(g for g in got if g[0] == 20) == [(20, n + 1, j) for n, (j, _) in enumerate(want[20])]


def test_another_row_of_the_query_id_is_a_candidate(spark):
    ids, x = [20, 20, 1], [[1.0, 0], [0, 1.0], [0.5, 0.5]]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(_frame(spark, ids, x)).collect())
    assert got == [(20, 1, 1), (20, 1, 1), (20, 2, 20), (20, 2, 20)]


def test_hits_against_plain_subsequences(spark):
    """Every window of every text and item, without retrieval: what it finds is found."""
    rng = random.Random(12)
    items = [prose(700 + i, rng.randint(8, 30), "aeinorst") for i in range(6)]
    texts = []
    for i in range(60):
        w = prose(800 + i, 50, "bcdfghjk").split()
        if i % 3:
            item = items[i % 6].split()
            keep = [x for x in item if rng.random() < rng.choice([0.3, 0.6, 0.8, 1.0])]
            at = rng.randrange(len(w))
            w[at:at] = keep
        texts.append(" ".join(w))
    got = _hits(spark, texts, items)
    for i, t in enumerate(texts):
        b, want = t.split(), []
        for k, item in enumerate(items):
            a = item.split()
            most, tail = int(1.6 * len(a) + 4), a[-5:]
            for s in range(len(b)):
                n = _brute_lcs(a, b[s : s + most])
                if n >= 0.6 * len(a) or (n >= 0.5 * len(a) and _brute_lcs(tail, b[s : s + most]) >= 0.8 * len(tail) and n >= 0.55 * len(a)):
                    want.append(k)
                    break
        assert set(want) <= set(got[i]) and all(_brute_lcs(items[k].split(), b) >= 0.5 * len(items[k].split()) for k in got[i])


def test_a_benchmark_in_parts(leaks):
    docs, bench, truth = leaks
    assert len(decontam.in_parts(bench, 10)) > 1
    one = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontam.all_matches(docs, bench).collect()}
    many = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontam.all_matches(docs, bench, most_items=30).collect()}
    assert len(one) == len(many) == 600 and {i for i, h in many.items() if h} == {i for i, h in one.items() if h} == set(truth)


def test_paraphrases_in_a_corpus_that_shares_the_words(spark):
    rng = random.Random(7)
    item = prose(901, 40, "aeinorst").split()
    texts = []
    for i in range(600):
        w = [x for x in reversed(item) if rng.random() < 1 / 6] + prose(1000 + i, 40, "bcdfghjk").split()
        texts.append(" ".join(w))
    for i in range(4):
        gone = set(rng.sample(range(35), 15))
        new = prose(2000 + i, 40, "lmpquvwx").split()
        around = prose(3000 + i, 60, "lmpquvwx").split()
        texts.append(" ".join([*around[:30], *[new[k] if k in gone else x for k, x in enumerate(item)], *around[30:]]))
    got = _hits(spark, texts, [" ".join(item)])
    assert {i for i, h in got.items() if h} == set(range(600, 604))
