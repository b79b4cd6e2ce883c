"""Hand-written cases of the speech operators."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import signal as G
from weftline.operators import speech as P

SEG = "source_id long, seg_idx long, s_ms long, e_ms long, text string, confidence double"
TURN = "source_id long, turn_idx long, ts_ms long, te_ms long, speaker string"


def _assign(spark, segs, turns):
    s = spark.createDataFrame([(1, i, a, b, "x", 1.0) for i, (a, b) in enumerate(segs)], SEG)
    t = spark.createDataFrame([(1, i, a, b, n) for i, (a, b, n) in enumerate(turns)], TURN)
    return {r["seg_idx"]: r["speaker"] for r in P.assign_speakers(s, t, bucket_ms=1500).collect()}


@pytest.mark.parametrize(
    "segs,turns,want",
    [
        ([(500, 2500)], [(0, 1000, "S0"), (1000, 3000, "S1")], {0: "S1"}),
        ([(0, 2000), (2000, 4000), (4000, 6000)], [(0, 2500, "S0"), (2500, 6000, "S1")], {0: "S0", 1: "S1", 2: "S1"}),
        ([(10000, 11000)], [(0, 2000, "S0")], {}),
        ([(2000, 2000)], [(0, 2000, "S0"), (2000, 4000, "S1")], {}),
        ([(1000, 3000)], [(0, 2000, "S0"), (2000, 4000, "S1")], {0: "S0"}),
        ([(0, 2000)], [(1000, 3000, "later"), (-1000, 1000, "earlier")], {0: "earlier"}),
        ([(0, 100000)], [(0, 100, "a"), (50, 99999, "b")], {0: "b"}),
    ],
)
def test_assign(spark, segs, turns, want):
    assert _assign(spark, segs, turns) == want


@pytest.mark.parametrize("ms,tier", [(0, "skip"), (59900, "skip"), (60000, "few_shot"), (599900, "few_shot"), (600000, "reduced_lora"), (1799900, "reduced_lora"), (1800000, "full_lora")])
def test_tiers(spark, ms, tier):
    c = spark.createDataFrame([(1, 1, 0, ms, "x", 1.0)], SEG).withColumn("speaker", F.lit("S"))
    assert P.summarize_speakers(c).first()["quality_tier"] == tier


def test_islands(spark):
    t = spark.createDataFrame([(1, 0, 0, 1000, "S0"), (1, 1, 1050, 2000, "S0"), (1, 2, 2300, 3000, "S0")], TURN)
    assert sorted((r["ts_ms"], r["te_ms"]) for r in P.merge_turns(t).collect()) == [(0, 2000), (2300, 3000)]


def _fold(spark, sizes, **kw):
    rows = [("s", c, float(sec)) for c, (n, sec) in enumerate(sizes) for _ in range(n)]
    got = P.fold_clusters(spark.createDataFrame(rows, "speaker string, cluster int, seconds double"), **kw)
    return {r["cluster"]: r["name"] for r in got.collect()}


def test_fold(spark):
    assert _fold(spark, [(10, 5), (2, 5)], least_chunks=5, least_seconds=20) == {0: "CHAR_A", 1: "CHAR_A"}
    assert _fold(spark, [(20, 3), (15, 4), (5, 2)], least_chunks=8, least_seconds=50) == {0: "CHAR_A", 1: "CHAR_B", 2: "CHAR_A"}
    assert _fold(spark, [(10, 3), (20, 3), (30, 3)], least_chunks=1, least_seconds=1, most=2) == {2: "CHAR_A", 1: "CHAR_B", 0: "CHAR_A"}
    assert set(_fold(spark, [(10, 3), (5, 3)], least_chunks=1, least_seconds=1, most=1).values()) == {"CHAR_A"}


def test_clusters(spark):
    vs = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [0.1, 0.99], [-1.0, -1.0]]
    v = spark.createDataFrame([("s", i, x) for i, x in enumerate(vs)], "speaker string, idx long, v array<double>")
    got = P.first_seen_labels(P.connected_labels(v, P.similar_pairs(v, 0.1)))
    assert {r["idx"]: r["label"] for r in got.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_long_chain_is_one_component(spark):
    v = spark.createDataFrame([("s", i) for i in range(60)], "speaker string, idx long")
    e = spark.createDataFrame([("s", i, i + 1) for i in range(59)], "speaker string, a long, b long")
    assert {r["root"] for r in P.connected_labels(v, e).collect()} == {0}


@pytest.mark.parametrize("target,want", [(None, 10), (5, 5)])
def test_rebalance(spark, target, want):
    rows = [(i, "neutral") for i in range(10)] + [(10, "angry"), (11, "angry"), (12, "happy")]
    got = P.rebalance(spark.createDataFrame(rows, "clip_id long, emotion string"), target).groupBy("emotion").count()
    assert {r["emotion"]: r["count"] for r in got.collect()} == dict.fromkeys(("neutral", "angry", "happy"), want)


def test_realign(spark):
    refs = spark.createDataFrame([(1, 0, "Hello world."), (1, 1, "How are you?")], "source_id long, n long, sentence string")
    segs = spark.createDataFrame([(1, 0, "helo wrld"), (1, 1, "zzzz qqqq xxxx")], "source_id long, seg_idx long, text string")
    got = {r["seg_idx"]: r["text"] for r in P.realign(segs, refs).collect()}
    assert got == {0: "Hello world.", 1: "zzzz qqqq xxxx"}


def _realigned(segs, refs, least, window):
    """One pass with plain ``difflib`` ratios."""
    from difflib import SequenceMatcher

    def best(text, lo, hi):
        found, ratio = -1, 0.0
        for i in range(lo, min(hi, len(refs))):
            a, b = text.strip().lower(), (refs[i] or "").strip().lower()
            if a and b and (r := SequenceMatcher(None, a, b).ratio()) > ratio:
                found, ratio = i, r
        return found, ratio

    out, last = [], None
    for n, text in segs:
        found, ratio = best(text, max(0, last - window), last + window + 1) if last is not None and window else (-1, 0.0)
        if ratio < least:
            found, ratio = best(text, 0, len(refs))
        good = found >= 0 and ratio >= least
        last = found if good else last
        out.append((n, refs[found] if good else text, round(ratio, 6), good))
    return out


def test_realign_in_cells_is_one_pass_over_all_sentences(spark):
    import random

    rng = random.Random(5)
    words = ["the", "over", "stone", "river", "\u00e9t\u00e9", "an", "light", "seven", "of", "Nacht"]
    refs = [" ".join(rng.choices(words, k=rng.choice((2, 6, 12, 60)))) + "." for _ in range(120)]
    refs[7] = refs[90] = refs[30]
    refs[11] = None
    segs = [(i, "".join(c for c in refs[i % 120] if rng.random() < 0.8) if refs[i % 120] and i % 9 else rng.choice(["zz qq xx", "", "of an of an the", " "])) for i in range(160)]
    r = spark.createDataFrame([(s, n, t) for s in (1, 2) for n, t in enumerate(refs[: 120 if s == 1 else 20])] , "source_id long, n long, sentence string")
    s = spark.createDataFrame([(k, n, t) for k in (1, 2, 3) for n, t in segs], "source_id long, seg_idx long, text string")
    for window in (0, 6):
        got = P.realign(s, r, window=window, cell=16).collect()
        for k, mine in ((1, refs), (2, refs[:20]), (3, [])):
            assert sorted((x["seg_idx"], x["text"], x["ratio"], x["replaced"]) for x in got if x["source_id"] == k) == _realigned(segs, mine, 0.6, window)


def test_export_names_what_there_is(spark):
    c = spark.createDataFrame([("A", None)], "speaker string, character string")
    with pytest.raises(ValueError, match="speakers: \\['A'\\]"):
        P.export_filter(c, "B")
    with pytest.raises(ValueError, match="no character labels"):
        P.export_filter(c, "A", "X")


def test_snr_of_few_frames(spark):
    f = spark.createDataFrame([(1, i, 1.0) for i in range(5)], "clip_id long, frame_idx long, power double")
    assert G.snr(f, "clip_id", "power").first()["snr"] == 30.0
