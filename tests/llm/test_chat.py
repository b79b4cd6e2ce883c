"""Snapshots of conversations against brute force, and the SQL on the test tables."""

import random

import duckdb
import pytest

from weftline.llm.chat import maximal_conversations, rendered
from weftline.llm.oracles import oracle_sql

SCHEMA = "conv_id long, turn long, role string, text string, k long, part string, m0 int"


def _rows():
    rng = random.Random(5)
    logs = []
    for _ in range(12):
        full = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "more", "text"])) for _ in range(rng.randint(1, 8))]
        for _ in range(rng.randint(1, 4)):
            logs.append(full[: rng.randint(1, len(full))])
    rng.shuffle(logs)
    return [(c, t, role, text, 0, "p", 1) for c, log in enumerate(logs) for t, (role, text) in enumerate(log)], logs


@pytest.mark.parametrize("per_piece", [2, 1024])
def test_against_brute_force(spark, per_piece):
    rows, logs = _rows()
    got = {r["conv_id"]: (r["n_turns"], r["n_equal"]) for r in maximal_conversations(spark.createDataFrame(rows, SCHEMA), rows_per_piece=per_piece).collect()}
    want = {}
    for i, a in enumerate(logs):
        if any(len(b) > len(a) and b[: len(a)] == a for b in logs) or any(b == a for b in logs[:i]):
            continue
        want[i] = (len(a), sum(b == a for b in logs))
    assert got == want


def test_rendered(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", 0, "", 0), (1, 1, None, None, 0, "", 0), (2, 0, "user", "hi", 0, "", 0)], SCHEMA)
    r = rendered(df, maximal_conversations(df)).collect()
    assert [(x["conv_id"], x["chat"]) for x in r] == [(1, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n")]


def test_odd(spark):
    assert maximal_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, None, None, None, 0, "", 0), (None, None, None, None, 0, "", 0), (3, 5, "u", "x" * 200_000, 0, "", 0)], SCHEMA)
    got = {r["conv_id"]: r["n_turns"] for r in maximal_conversations(df).collect()}
    assert got == {None: 2, 3: 1}
    assert rendered(df, maximal_conversations(df)).count() == 2


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = {(r[0], r[1], r[2], r[3], r[4]) for r in con.execute(oracle_sql()["op5_chat_formatting"]).fetchall()}
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {tuple(r) for r in rendered(turns, maximal_conversations(turns)).collect()}
    assert got == want
