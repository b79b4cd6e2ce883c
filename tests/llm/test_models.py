"""Language, toxicity and quality on small made-up corpora; their parts against brute force."""

import random
import zlib

import numpy as np
import pytest

from weftline.llm import language, quality, toxicity
from weftline.llm.features import bounded_sample, byte_grams
from weftline.llm.words import chunks

from .conftest import COLUMNS, prose

LETTERS = {"aa": "aeinorst", "bb": "uvwxyzkl", "cc": "äöüßghpm"}


def _fold(i, ways):
    return zlib.crc32(str(i).encode()) % ways


@pytest.fixture(scope="module")
def spoken(spark):
    rows = []
    for i in range(900):
        lang = "abc"[i % 3] * 2
        rows.append((i, prose(i, 30, LETTERS[lang]), lang if i % 10 else None, "s", None, 0, 0, ""))
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def test_language_held_out(spoken):
    model = language.fit(spoken, most_rows=300)
    got = {r["doc_id"]: r for r in language.predict(spoken, model).collect()}
    assert len(got) == 900
    held = [i for i in got if _fold(i, 3) == 1]
    right = sum(got[i]["lang_pred"] == "abc"[i % 3] * 2 for i in held)
    assert right / len(held) > 0.98 and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd(spoken, odd, nothing, spark):
    model = language.fit(spoken, most_rows=300)
    out = language.predict(odd, model)
    assert out.count() == odd.count()
    und = {r["doc_id"] for r in out.where("lang_pred = 'und'").collect()}
    assert {3, 4, 5} <= und and 6 not in und
    assert language.predict(nothing, model).count() == 0
    empty = language.fit(nothing)
    assert {r["lang_pred"] for r in language.predict(odd, empty).collect()} == {"und"}
    far = spark.createDataFrame([(1, "漢字 漢字 漢字 漢字", None, None, None, 0, 0, "")], COLUMNS)
    assert language.predict(far, model).first()["rejected"]


def test_byte_grams_stay_within_rows():
    import pyarrow as pa

    a = byte_grams(next(chunks(pa.array(["ab", "cd", ""]))), 1024)
    b = byte_grams(next(chunks(pa.array(["ab"]))), 1024)
    assert (a[0] == b[0]).all() and a[2].sum() == 0 and a[1].sum() == a[0].sum() == 3


def _plain_grams(text, dims, fold):
    out = np.zeros(dims)
    b = [(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32) if fold else c for c in text.encode()]
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            code = 0
            for c in b[i : i + n]:
                code = (code * 257 + c + 1) % 2**32
            out[(code * 2654435761) % 2**32 >> (32 - dims.bit_length() + 1)] += 1
    return out


def test_language_against_plain_cosines(spoken):
    model = language.fit(spoken, most_rows=300)
    got = {r["doc_id"]: r for r in language.predict(spoken, model).where("doc_id < 60").collect()}
    for r in spoken.where("doc_id < 60").collect():
        v = np.log1p(_plain_grams(r["text"], language.DIMS, True)) * model.idf
        cos = [float(v @ c) / float(np.linalg.norm(v)) for c in model.centroids]
        assert got[r["doc_id"]]["lang_pred"] == model.langs[int(np.argmax(cos))]
        assert abs(got[r["doc_id"]]["score"] - max(cos)) < 1e-4


def test_byte_grams_of_long_texts_are_counted_in_pieces(monkeypatch):
    import pyarrow as pa

    from weftline.llm import features

    texts = [prose(1, 300), "", prose(2, 3), prose(3, 700)]
    whole = byte_grams(next(chunks(pa.array(texts))), 512)
    monkeypatch.setattr(features, "PIECE", 101)
    assert (byte_grams(next(chunks(pa.array(texts))), 512) == whole).all()
    for fold in (True, False):
        monkeypatch.setattr(features, "PIECE", 64)
        assert (byte_grams(next(chunks(pa.array(texts))), 512, fold=fold)[2] == _plain_grams(texts[2], 512, fold)).all()


def test_byte_grams_take_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    c = next(chunks(pa.array(["ab cd " * (4 << 20)])))
    tracemalloc.start()
    byte_grams(c, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def test_ratings_of_null_labels(spark):
    rows = [(0, 0, 0), (1, 0, None), (2, 1, 1), (3, 1, 0), (4, 1, None), (5, None, 1), (6, None, None)]
    got = {r["k"]: r["g"] for r in spark.createDataFrame(rows, "k int, quality int, toxic int").select("k", quality.grade_column().alias("g")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None}


def _brute_segments(s):
    """All maximal segments: take the best segment (leftmost, shortest), then go on left and right of it."""
    best, where = 0.0, None
    for i in range(len(s)):
        t = 0.0
        for j in range(i, len(s)):
            t += s[j]
            if t > best + 1e-12:
                best, where = t, (i, j)
    if where is None:
        return []
    i, j = where
    left = _brute_segments(s[:i])
    right = [(a + j + 1, b + j + 1, x) for a, b, x in _brute_segments(s[j + 1 :])]
    return [*left, (i, j, best), *right]


@pytest.mark.parametrize("seed", range(25))
def test_segments(seed):
    rng = random.Random(seed)
    s = [round(rng.choice([-1.0, -1.0, rng.uniform(0.1, 4), rng.uniform(-3, 1)]), 3) for _ in range(rng.randint(0, 40))]
    run = np.concatenate(([0.0], np.cumsum(s)))
    good = [i for i, x in enumerate(s) if x > 0]
    got = [(good[a], good[b], x) for a, b, x in toxicity.segments([run[i] for i in good], [run[i + 1] for i in good])]
    want = _brute_segments(s)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(4)
    bad = ["vile", "scum", "rot", "filth", "grub"]
    docs, labels = [], []
    for i in range(1200):
        w = prose(i, 60).split()
        toxic, low = i % 6 == 0, i % 7 == 3
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        if low:
            w = [x.upper() + "$$" for x in w]
        docs.append((i, " ".join(w), None, "s", None, 0, 0, ""))
        labels.append((i, int(not low), int(toxic)))
    return spark.createDataFrame(docs, COLUMNS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(rated, odd, nothing):
    docs, labels = rated
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if _fold(i, 5) == 0]
    assert all(got[i]["predicted"] == (i % 6 == 0) for i in held)
    r = got[next(i for i in held if i % 6 == 0)]
    text = docs.where(f"doc_id = {r['doc_id']}").first()["text"].lower().encode()
    assert any(any(b in text[s["start"] : s["end"]].decode() for b in ("vile", "scum", "rot", "filth", "grub")) for s in r["segments"])
    out = toxicity.score(odd, model)
    assert out.count() == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in out.collect())
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_against_plain_scores(rated):
    """Words, segments and evidence of each text one by one, from the model's own tokens."""
    import math

    import pyarrow as pa

    from weftline.llm.words import words

    docs, labels = rated
    m = toxicity.fit(docs, labels)
    scores = dict(zip(m.tokens.tolist(), m.scores.tolist(), strict=True))
    got = {r["doc_id"]: r for r in toxicity.score(docs, m).where("doc_id < 60").collect()}
    for r in docs.where("doc_id < 60").collect():
        h = words(next(chunks(pa.array([r["text"].lower()]))), signs=True).hash.tolist()
        each = [max(0.0, m.lam * x - (m.log_k + math.log(max(len(h), 1)))) for _, _, x in _brute_segments([scores.get(x, -m.drift) for x in h])]
        z = m.weights[0] + m.weights[1] * math.log1p(max(each, default=0.0)) + m.weights[2] * math.log1p(sum(each))
        assert abs(got[r["doc_id"]]["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and len(got[r["doc_id"]]["segments"]) == len(each)


def test_toxic_column_is_the_prediction(rated, odd):
    docs, labels = rated
    m = toxicity.fit(docs, labels)
    for d in (docs, odd):
        toxic = toxicity.toxic_column(d.sparkSession, m)
        want = sorted(str(r["doc_id"]) for r in toxicity.score(d, m).where("predicted = 1").collect())
        assert sorted(str(r["doc_id"]) for r in d.where(toxic(d["text"])).collect()) == want


def test_toxicity_without_labels(odd, nothing, spark):
    model = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(odd, model).collect()} == {0}
    assert toxicity.score(nothing, toxicity.fit(nothing, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))).count() == 0


def test_quality_held_out(rated, odd, nothing):
    docs, labels = rated
    model = quality.fit(docs, labels.select("doc_id", quality.grade_column().alias("grade")))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [i for i in got if _fold(i, 5) == 0]
    assert np.mean([got[i]["selected"] == (i % 7 != 3) for i in held]) > 0.97
    for r in got.values():
        assert r["tail"][0] >= r["tail"][1] and abs(sum(r["tail"]) - r["expected_grade"]) < 1e-9
    out = quality.score(odd, model)
    assert out.count() == odd.count() and not any(r["selected"] for r in out.collect() if r["doc_id"] in (3, 4))
    assert quality.score(nothing, quality.fit(nothing, labels.limit(0).select("doc_id", quality.grade_column().alias("grade")))).count() == 0


def test_quality_against_plain_sums(rated):
    docs, labels = rated
    m = quality.fit(docs, labels.select("doc_id", quality.grade_column().alias("grade")))
    import pyarrow as pa

    got = {r["doc_id"]: r for r in quality.score(docs, m).where("doc_id < 30").collect()}
    for r in docs.where("doc_id < 30").collect():
        grams = np.sqrt(_plain_grams(r["text"], quality.DIMS, False))
        counts = np.sqrt(quality.word_counts(next(chunks(pa.array([r["text"]]))), quality.DIMS)[0])
        z = float(np.concatenate((grams / np.linalg.norm(grams), counts / np.linalg.norm(counts))) @ m.weights)
        tail = [1 / (1 + np.exp(t - z)) for t in m.thresholds]
        assert abs(got[r["doc_id"]]["expected_grade"] - sum(tail)) < 1e-3 and got[r["doc_id"]]["selected"] == (tail[0] >= 0.5)


def test_ordinal_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 3)).astype(np.float32)
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=2000)
    y = (z > -1).astype(int) + (z > 1.5)
    m = quality.fit_ordinal(x, y, 3)
    assert abs(m.weights[0] - 2) < 0.25 and abs(m.weights[1] + 1) < 0.25 and abs(m.thresholds[0] + 1) < 0.25 and abs(m.thresholds[1] - 1.5) < 0.25


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(20000)], "doc_id long, y int")
    got = bounded_sample(df, "doc_id", 1000, by="y")
    n = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
    assert n[1] == 200 and 400 < n[0] < 600
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in bounded_sample(df.repartition(7), "doc_id", 1000, by="y").select("doc_id").collect())
