"""Archives: a round trip, the types of records, and the merge against sorting."""

import base64
import hashlib
import random

from weftline.llm import warc

SCHEMA = "page_id long, url string, html string, `offset` int, sha string"


def _pages(spark):
    rng = random.Random(3)
    rows = [(i, f"http://{rng.choice('abc')}.example.org/{rng.randint(0, 20)}?x={i % 3}", f"<p>{'ä' * (i % 40)} {i % 25}</p>" if i % 5 else "same", 7, "s") for i in range(400)]
    rows += [(400, None, None, None, None), (401, "not a url\r\nX: y", "", 1, "t"), (402, "http://[bad", "x" * 300_000, 1, "t")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_round_trip(spark):
    df, rows = _pages(spark)
    out = {r["page_id"]: r for r in warc.archive(df.repartition(5), ranges=4).collect()}
    assert len(out) == len(rows)
    first = {}
    for i, _, html, *_ in rows:
        first.setdefault(html or "", i)
    for i, _, html, *_ in rows:
        p, r = (html or "").encode(), out[i]
        want = base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), want)
        response = first[html or ""] == i
        assert r["record_type"] == ("response" if response else "revisit")
        assert r["refers_to"] == (None if response else first[html or ""])
    order = sorted(out.values(), key=lambda r: (r["part"], r["place"]))
    keys = [(r["url_key"], r["ts"], r["page_id"]) for r in order]
    assert keys == sorted(keys)


def test_passes_of_merging(spark):
    df, rows = _pages(spark)
    folder = warc.new_path(spark, "t")
    files = [r["file"] for r in warc.write_archives(df.repartition(6), folder, roll_bytes=4000).collect()]
    assert len(files) > 8
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(4)
    runs = [r["run"] for r in warc.capture_runs(listed, folder, run_rows=10).collect()]
    got = warc.merged_index(spark, runs, folder, ranges=5, fan_in=3).collect()
    assert len(got) == len(rows) and len({r["page_id"] for r in got}) == len(rows)


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        got = list(warc.LoserTree([iter(r) for r in runs], order=lambda x: x))
        assert got == sorted(x for r in runs for x in r)


def test_no_pages_and_repeated_rows(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "http://a.b/", "x", 0, ""), (1, "http://a.b/", "x", 0, ""), (None, "http://a.b/", "x", 0, ""), (None, None, "y", 0, "")], SCHEMA)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.archive(df).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]


def test_url_keys():
    assert warc.url_key("https://www.Example.org/A?b=1") == "org,example)/a?b=1"
    assert warc.url_key(None) == ""
