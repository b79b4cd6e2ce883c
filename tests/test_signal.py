"""Silence, mono samples and slices against plain versions of their rules."""

import math

import numpy as np
import pytest

from weftline.operators import signal as G

RATE = 1000


def _clips():
    rng = np.random.default_rng(3)
    out = {}
    for k in range(14):
        x = rng.uniform(-0.5, 0.5, rng.integers(40, 2600))
        for _ in range(rng.integers(0, 4)):
            a = rng.integers(0, len(x))
            x[a : a + rng.integers(20, 900)] *= 10.0 ** -rng.integers(1, 5)
        if k % 3 == 0:
            x[: rng.integers(1, 400)] *= 0.003
            x[-int(rng.integers(1, 400)) :] *= 0.0021
        out[k] = x
    out[20] = np.zeros(700)
    out[21] = -np.abs(rng.uniform(0.2, 0.5, 700))  # a loud negative half-wave isn't silence
    return out


@pytest.fixture(scope="module")
def clips():
    return _clips()


@pytest.fixture(scope="module")
def samples(spark, clips):
    return spark.createDataFrame([(k, i, float(v)) for k, x in clips.items() for i, v in enumerate(x)], "clip_id long, i long, x double").repartition(3)


def _db(x):
    return 10 * math.log10(max(float(np.mean(x**2)), 1e-12)) if len(x) else -120.0


def test_auto_trim(samples, clips):
    got = {r["clip_id"]: (r["first"], r["end"]) for r in G.auto_trim(samples, RATE).collect()}
    for k, x in clips.items():
        n = 30
        want = (0, len(x))
        loud = [f for f in range(len(x) // n) if _db(x[f * n : f * n + n]) > -40]
        if len(x) >= 5 * n and loud:
            want = (max(0, loud[0] - 3) * n, min(len(x), (loud[-1] + 4) * n))
        assert got[k] == want, k


def test_trim_chunk_silence(samples, clips):
    def lead(x, most):
        at = 0
        while at < len(x) and _db(x[at : at + 10]) < most:
            at += 10
        return min(at, len(x))

    got = {r["clip_id"]: (r["start_ms"], r["end_ms"]) for r in G.trim_chunk_silence(samples, RATE).collect()}
    for k, x in clips.items():
        start, end = max(0, lead(x, -45) - 30), len(x) - max(0, lead(x[::-1], -55) - 100)
        assert got[k] == ((0, len(x)) if end <= start else (start, end)), k


def test_detect_nonsilent(samples, clips):
    got: dict[int, list] = {}
    for r in G.detect_nonsilent(samples, RATE).collect():
        got.setdefault(r["clip_id"], []).append((r["start_ms"], r["end_ms"]))
    for k, x in clips.items():
        quiet = np.zeros(len(x), dtype=bool)
        for a in range(0, len(x) - 300 + 1, 10):
            if _db(x[a : a + 300]) <= -40:
                quiet[a : a + 300] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([1], quiet, [1])).astype(int)))
        assert sorted(got.get(k, [])) == list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), k


def test_mono_float(spark):
    rows = [(1, "int16", [32767.0, -32768.0]), (1, "int16", [16384.0, 16384.0]), (2, "int32", [2.0**31 - 1]), (3, "uint8", [255.0]), (3, "uint8", [128.0, 0.0]), (4, "float", [0.5, 0.25]), (5, "float", [4.0]), (5, "float", [-2.0, 0.0])]
    got = sorted((r["clip"], round(r["x"], 6)) for r in G.mono_float(spark.createDataFrame(rows, "clip long, kind string, channels array<double>"), "clip").collect())
    assert got == sorted([(1, round(-0.5 / 32768, 6)), (1, 0.5), (2, 1.0), (3, 1.0), (3, round(-64 / 127, 6)), (4, 0.375), (5, 1.0), (5, -0.25)])


def test_slices(spark):
    s = spark.createDataFrame([(0, 500, 9000), (100, 150, 9000), (400, 900, 9000), (700, 800, 9000)], "s_ms long, e_ms long, size long")
    assert [(r["a"], r["b"], r["too_short"]) for r in G.slice_bounds(s, 16000).collect()] == [(0, 8000, False), (1600, 2400, True), (6400, 9000, False), (9000, 9000, True)]
