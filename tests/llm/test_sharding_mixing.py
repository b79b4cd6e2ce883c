"""Sharding and mixing against what the definitions say."""

from collections import defaultdict

import numpy as np
import pytest

from weftline.llm.mixing import _stride, mix_plan, mixed, mixed_documents, split_tree, water_fill
from weftline.llm.sharding import shard_by_size

from .conftest import COLUMNS, prose, rows_of


def _check(rows, out, n):
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_sizes_are_near_equal_and_copies_together(spark):
    texts = [prose(i // 3, 20 + i % 50) for i in range(1500)]
    docs = spark.createDataFrame(rows_of(texts), COLUMNS)
    out = shard_by_size(docs, 10).collect()
    _check(texts, out, 10)
    size, where = defaultdict(int), defaultdict(set)
    for r in out:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16
        size[r["shard"]] += r["size"]
        where[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(size.values()) / 10
    assert len(size) == 10 and max(size.values()) < 1.06 * mean and min(size.values()) > 0.94 * mean
    assert all(len(w) == 1 for w in where.values())


def test_hot_text_is_split(spark):
    texts = ["same text over and over"] * 800 + [prose(i, 5) for i in range(1200)]
    out = shard_by_size(spark.createDataFrame(rows_of(texts), COLUMNS), 8).collect()
    slots = _check(texts, out, 8)
    size = defaultdict(int)
    for r in out:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 8
    assert len(slots) == 8 and max(size.values()) < 1.1 * mean


def test_hot_text_without_ids_is_split(spark):
    rows = [(None, "same text over and over", None, "s", None, 0, 0, "")] * 900 + rows_of([prose(i, 5) for i in range(900)])
    out = shard_by_size(spark.createDataFrame(rows, COLUMNS), 8).collect()
    slots = _check(rows, out, 8)
    assert len(slots) == 8 and len({r["shard"] for r in out if r["doc_id"] is None}) > 2


def test_sharding_odd(odd, nothing):
    _check(odd.collect(), shard_by_size(odd, 4).collect(), 4)
    assert shard_by_size(nothing, 4).count() == 0
    a, b = (sorted(map(str, shard_by_size(odd, 4).collect())) for _ in range(2))
    assert a == b


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 5], [1, 1, 1, 1000], [0, 50], []])
def test_water_fill(sizes):
    w = [[5, 2, 1][i % 3] for i in range(len(sizes))]
    t = water_fill(sizes, w, sum(sizes))
    assert all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
    assert abs(sum(t) - min(sum(sizes), 3 * sum(s for s in sizes))) < 1e-6 or any(x >= 3 * s - 1e-9 for x, s in zip(t, sizes, strict=True))


def test_tree_sums():
    t = split_tree([100, 7, 0, 1234], 16, 5)
    assert t.sum(axis=1).tolist() == [100, 7, 0, 1234] and (t >= 0).all()
    assert (t == split_tree([100, 7, 0, 1234], 16, 5)).all()
    assert np.ptp(t.sum(axis=0)) <= 4


def test_mix_near_targets(spark):
    rows = [(i, prose(i, 10 + i % 30), None, ["a", "b", "c", None][i % 4 if i % 7 else 0], None, 0, 0, "") for i in range(3000)]
    plan = mix_plan(spark.createDataFrame(rows, COLUMNS), rows_per_cell=100).collect()
    taken, target = defaultdict(int), {}
    for r in plan:
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"] and r["size"] == len(rows[r["doc_id"]][1].split())
        assert len(r["places"]) == r["copies"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(target) == 4
    for s, t in target.items():
        assert abs(taken[s] - t) <= 40
    total = sum(r["size"] for r in plan)
    assert abs(sum(target.values()) - total) < 1e-6 * total


def test_mix_places(spark):
    rows = [(i, prose(i, 20), None, "ab"[i % 2], None, 0, 0, "") for i in range(2000)]
    plan = mix_plan(spark.createDataFrame(rows, COLUMNS), n_shards=4)
    got = mixed(plan).collect()
    shards = defaultdict(int)
    for r in got:
        shards[r["shard"]] += 1
    assert len(shards) == 4 and max(shards.values()) < 1.2 * min(shards.values())
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)


def test_mix_against_a_plain_line(spark):
    """The line of a source laid out one document after the other, and blocks handed to shards one by one."""
    from pyspark.sql import functions as F

    rows = [(i, prose(i, 3 + i % 40), None, "abc"[i % 3] if i % 5 else "a", None, 0, 0, "") for i in range(900)]
    docs = spark.createDataFrame(rows, COLUMNS)
    plan = {r["doc_id"]: r for r in mix_plan(docs, n_shards=5, blocks_per_shard=8, rows_per_cell=50).collect()}
    key = {r["doc_id"]: (r["h"], r["doc_id"]) for r in docs.select("doc_id", F.xxhash64(F.lit(23), "doc_id", "source", F.xxhash64("text")).alias("h")).collect()}
    sizes = {s: sum(r["size"] for r in plan.values() if r["source"] == s) for s in "abc"}
    target = dict(zip("abc", water_fill(list(sizes.values()), [5, 2, 1], sum(sizes.values())), strict=True))
    about = max(64, -(-sum(sizes.values()) // 40))
    quota = {s: max(1, round(t / about)) for s, t in target.items()}
    tree = split_tree(list(quota.values()), 5, 23)
    for k, s in enumerate("abc"):
        owner = [next(j for j, e in enumerate(np.cumsum(tree[k])) if b * _stride(quota[s], 23) % quota[s] < e) for b in range(quota[s])]
        assert [owner.count(j) for j in range(5)] == tree[k].tolist()
        at, want = 0, defaultdict(list)
        mine = sorted((d for d, r in plan.items() if r["source"] == s), key=key.get)
        for epoch in range(3):
            for d in mine:
                middle = at + plan[d]["size"] / 2
                if middle <= target[s]:
                    b = min(int(middle // (target[s] / quota[s])), quota[s] - 1)
                    want[d].append((epoch, b, owner[b]))
                at += plan[d]["size"]
        for d in mine:
            assert plan[d]["target"] == pytest.approx(target[s])
            assert [(p["copy"], p["block"], p["shard"]) for p in plan[d]["places"]] == want[d]


def test_mixed_documents_are_shuffled_by_shard(spark):
    from collections import Counter

    rows = [(i if i % 9 else None, prose(i, 20), None, "ab"[i % 2], None, 0, 0, "") for i in range(600)]
    docs = spark.createDataFrame(rows, COLUMNS)
    plan = mix_plan(docs, n_shards=4).collect()
    out = mixed_documents(docs, n_shards=4)
    assert out.columns == docs.columns
    got = [r["text"] for r in out.collect()]
    text = {(r["doc_id"], r["text_key"]): r for r in plan}
    assert len(text) == 600 and len(got) == sum(r["copies"] for r in plan)
    assert sorted(Counter(Counter(got).values()).items()) == sorted(Counter(r["copies"] for r in plan if r["copies"]).items())
    assert got == [r["text"] for r in mixed_documents(docs.repartition(7), n_shards=4).collect()]
    assert got != sorted(got)


def test_mix_odd(odd, nothing):
    out = mix_plan(odd).collect()
    assert len(out) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in out)
    assert all(r["size"] == 0 for r in out if r["doc_id"] in (3, 4, 5))
    assert mix_plan(nothing).count() == 0
