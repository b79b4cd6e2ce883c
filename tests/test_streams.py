"""Log events by hand-written lines."""

from weftline.streaming import events as V

LINE = "[chapter 3/8] chunk 42/126 (215/1043 total) - 12m30s elapsed, ~65m00s remaining, RTF 0.17x"


def test_chunk_line(spark):
    r = V.events(spark.createDataFrame([(LINE + "\r\n",)], "line string")).first()
    got = tuple(r[c] for c in ("kind", "chapter_idx", "chapter_total", "chunk_idx", "chunk_total", "total_done", "total_chunks", "elapsed_s", "eta_s", "rtf"))
    assert got == ("chunk", 3, 8, 42, 126, 215, 1043, 750, 3900, 0.17)


def test_noise(spark):
    lines = ["WARNING: Detected 2x repetition of token 123 at position 45", "WARNING:x: Detected 3x repetition of token 9", "forcing EOS token, x", "plain"]
    got = [r["line"] for r in V.rewrite_noise(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == ["[info] alignment fix applied on token 123 at position 45", "[info] alignment fix applied on token 9", "plain"]


def test_unknown_stage(spark):
    lines = ["[voice_pack_analyze] asr: 12.34s", "[voice_pack_analyze] nap: 1s", "asr: 3s"]
    got = V.stage_stamps(spark.createDataFrame([(x,) for x in lines], "line string")).select("stage", "elapsed_s").collect()
    assert [tuple(r) for r in got] == [("asr", 12.34)]


def test_backends():
    import pytest

    from weftline.functions.sql import Backends

    b = Backends()
    b.add("one", lambda df: df, ("fi", "en"))
    b.add("two", lambda df: df, ("en",))
    assert b.names() == ["one", "two"] and b.names("fi") == ["one"]
    with pytest.raises(ValueError):
        b.add("one", lambda df: df)
    with pytest.raises(ValueError):
        b.add("", lambda df: df)
    with pytest.raises(KeyError, match="one"):
        b.get("three")
