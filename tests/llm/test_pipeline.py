"""The pipeline's stages, each against a brute-force version of its decision, and the registered queries."""

from collections import Counter

import corpus_pipeline as P
import pytest

from weftline.llm import mixing, toxicity
from weftline.llm.queries import queries

from .conftest import COLUMNS, prose
from .test_ngram import brute


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in P.STAGES:
        before, docs = docs, P.written(stage(spark, docs, sf_dir), "t-" + name)
        out.append((name, before, docs))
    return out


def test_columns(staged):
    for i, (name, before, after) in enumerate(staged):
        if i < len(staged) - 1:
            assert after.columns == before.columns, name


def test_toxic_documents_go(staged, spark, sf_dir):
    _, before, after = staged[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = toxicity.score(before, toxicity.fit(before, labels)).collect()
    gone = Counter(r[0] for r in before.select("doc_id").collect()) - Counter(r[0] for r in after.select("doc_id").collect())
    assert gone == Counter(r["doc_id"] for r in scores if r["score"] >= 0.5)
    marked = {t: {r[0] for r in labels.where(f"toxic = {t}").collect()} for t in (0, 1)}
    assert not set(gone) & marked[0] and len(set(gone) & marked[1]) >= 0.5 * len(marked[1]) > 0


def test_one_of_each_group_stays(staged):
    _, before, after = staged[1]
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    want = {int(c) for _, _, c in brute(rows)}
    assert {r[0] for r in after.select("doc_id").collect()} == want


def test_contaminated_documents_go(staged, spark, sf_dir):
    _, before, after = staged[2]
    items = [" ".join(r[0].lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    holds = {r["doc_id"] for r in before.collect() if any(i in " ".join(r["text"].lower().split()) for i in items)}
    assert holds and {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()} == holds


def test_mix_takes_what_it_plans(staged):
    _, before, after = staged[3]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(before).collect() if r["copies"]}
    assert dict(Counter(r[0] for r in after.select("doc_id").collect())) == plan


def test_shards(staged):
    _, before, after = staged[4]
    rows = after.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in before.select("doc_id").collect())
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["size"] == len(r["text"].encode()) + 16 for r in rows)


def test_odd_documents_pass(odd, spark, sf_dir):
    """Nothing toxic or contaminated; of copies one stays, null and blank texts stay until the mix, which takes no words from them."""
    docs, ids = odd, []
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, sf_dir), "t-odd-" + name)
        ids.append(Counter(r[0] for r in docs.select("doc_id").collect()))
    everything = Counter(r[0] for r in odd.select("doc_id").collect())
    assert ids[0] == everything and ids[2] == ids[1]
    # rows 0, 1 and the null id hold one text, row 2 nearly; 7 and 8 differ in case; 10 and 11 are equal; 3 and its repeated row are null
    assert ids[1] == Counter({0: 1, 3: 2, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1, 10: 1, 12: 1, None: 1})
    assert set(ids[3]) <= {0, 6, 7, 9, 10, 12} and ids[4] == ids[3] and all(n <= 3 for n in ids[3].values()) and 9 in ids[3]
    assert {"shard_before", "shard", "slot", "size", "text_crc32"} <= set(docs.columns) and {r[0] for r in docs.select("shard_before").collect()} == {2}


def test_no_documents(nothing, spark, sf_dir):
    docs = nothing
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, sf_dir), "t-none-" + name)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_only_copies_go_where_ids_are_null_or_repeated(spark, sf_dir):
    a, b, c, d = (prose(700 + i, 40) for i in range(4))
    rows = [(5, a), (5, b), (3, a), (None, a), (None, c), (None, d), (None, d), (7, d + " tail"), (8, None), (None, None), (9, b.upper())]
    docs = spark.createDataFrame([(i, t, None, "s", None, 1, 2, "x") for i, t in rows], COLUMNS).repartition(3)
    left = Counter((r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, sf_dir).collect())
    assert left == Counter([(3, a), (5, b), (None, c), (7, d + " tail"), (8, None), (None, None)])


def test_shards_keep_texts_of_one_id_apart(spark, sf_dir):
    from zlib import crc32

    texts = [prose(800 + i, 5 + 3 * i) for i in range(12)]
    docs = spark.createDataFrame([(i, t, None, "s", None, 1, 2, "x") for i in (4, None) for t in [*texts, texts[0], None]], COLUMNS).repartition(3)
    rows = P.shard(spark, docs, sf_dir).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in rows)
    assert all(r["text_crc32"] == (None if r["text"] is None else crc32(r["text"].encode())) for r in rows)
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
