"""Books, packs, word lists and end-to-end runs on real folders, with stand-ins for optional libraries and models."""

import pytest

from weftline.functions.sql import Backends
from weftline.operators import analysis as A
from weftline.sources import books as B
from weftline.sources import lexicons as L
from weftline.sources import records as R


def _fake(content):
    if content == b"broken":
        raise OSError("no PDF")
    pages = content.decode().split("\f")
    return pages, {"title": " Own Title "} if pages[0].startswith("Chapter") else {}


def test_pdf_files(spark):
    files = [
        ("/x/my_first-book.pdf", "Before.\fChapter 1\nOne text.\f \fChapter 2\nTwo.\nmore\fthe end\fChapter 1\nagain".encode()),
        ("/x/plain.pdf", b"only\ftext here"), ("/x/scan.pdf", b" \f\n"), ("/x/bad.pdf", b"broken"), ("/x/b.pdf", b"Chapter 1\nA."),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {(r["path"], r["idx"]): (r["title"], r["content"], r["page_start"], r["page_end"], r["error"]) for r in B.pdf_chapters(df, _fake).collect()}
    first = "/x/my_first-book.pdf"
    assert [got[first, i][:4] for i in range(4)] == [("Alkusanat", "Before.", 1, 2), ("Chapter 1", "One text.", 2, 4), ("Chapter 2", "Two. more the end", 4, 6), ("Chapter 1", "again", 6, 6)]
    assert got["/x/plain.pdf", 0][:4] == ("Alkusanat", "only text here", 1, 2)
    assert got["/x/scan.pdf", None][4] == "PDF contains no extractable text (2 pages)" and got["/x/bad.pdf", None][4] == "cannot open PDF: OSError"
    titles = {r["path"]: r["title"] for r in B.pdf_pages(df, _fake).where("error is null").collect()}
    assert titles[first] == "My First Book" and titles["/x/b.pdf"] == "Own Title"


def test_books_by_their_ending(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("text ä".encode() + b"\xff")
    (tmp_path / "b.pdf").write_bytes(b"Chapter 1\nhello")
    got = {r["path"].rpartition("/")[2]: r["content"] for r in B.read_books(spark, str(tmp_path), extract=_fake).collect()}
    assert got == {"a.TXT": "text ä�", "b.pdf": "hello"}


def test_pack_folders(spark, tmp_path):
    def pack(name, meta, *files):
        (tmp_path / name).mkdir()
        for f in files:
            (tmp_path / name / f).write_text("x")
        if meta is not None:
            (tmp_path / name / "meta.yaml").write_text(meta)

    pack("p1", "name: zeta\ntier: few_shot", "sample.wav", "reference.wav")
    pack("p2", "name: Alpha\ntier: full_lora\nformat_version: 1", "sample.wav", "adapter.pt")
    pack("p3", "name: [", "sample.wav")
    pack("p4", "tier: gold\nformat_version: 9")
    pack("p5", None, "sample.wav")
    pack("p6", "- 1", "sample.wav")
    packs = R.read_packs(spark, str(tmp_path))
    issues = {r["pack"]: r["issues"] for r in R.pack_issues(packs).collect()}
    assert issues["p1"] == issues["p2"] == []
    assert issues["p3"][0].startswith("meta.yaml parse error") and issues["p6"] == ["meta.yaml is not a mapping"] and issues["p5"] == ["meta.yaml missing"]
    assert issues["p4"] == ["meta.yaml missing required key: name", "unknown tier gold", "format version 9 is newer than supported", "sample.wav missing"]
    assert sorted((r["place"], r["name"]) for r in R.list_packs(packs).collect()) == [(1, "Alpha"), (2, "zeta")]
    assert R.folder_size(spark, str(tmp_path)).first()["files"] == 12


def test_overrides_of_word_lists(spark, tmp_path):
    (tmp_path / "own.yaml").write_text("en_abbreviations:\n  etc.: and so on\n  approx.: about\n  Dr.: null\nen_acronyms: {SWAT: SWAT, NASA: null}\nother: 3\n")
    own = L.read_overrides(str(tmp_path / "own.yaml"))
    rows = {(r["lexicon"], r["key"]): r["value"] for r in L.lexicon(spark, "en_abbreviations", "en_acronyms", overrides=own).collect()}
    assert rows["en_abbreviations", "etc."] == "and so on" and rows["en_abbreviations", "approx."] == "about" and ("en_abbreviations", "Dr.") not in rows
    assert ("en_acronyms", "SWAT") in rows and ("en_acronyms", "NASA") not in rows and ("en_acronyms", "NATO") in rows
    assert L.read_overrides(str(tmp_path / "none.yaml")) == {}


def test_backends_of_an_analysis(spark, tmp_path):
    recordings = spark.createDataFrame([(1,), (2,)], "source_id long")
    b = Backends()
    b.add("fake", lambda rec: rec.selectExpr("source_id", "explode(sequence(0, 3)) AS seg_idx").selectExpr("*", "seg_idx * 2000 AS s_ms", "seg_idx * 2000 + 1500 AS e_ms", "'hello' AS text", "0.9D AS confidence"))
    b.add("turns", lambda rec: rec.selectExpr("source_id", "0 AS turn_idx", "0 AS ts_ms", "5000 AS te_ms", "'A' AS speaker"))
    a = A.analyze(recordings, transcribe=b.get("fake"), diarize=b.get("turns"))
    assert [(r["speaker"], r["chunk_count"], r["total_seconds"]) for r in a.speakers.collect()] == [("A", 6, 9.0)]
    paths = A.write_analysis(a, str(tmp_path / "out"))
    assert R.read_transcripts(spark, paths["transcripts"]).count() == 6
    assert "| A | 0.2 | 6 | 1.50 | skip |" in (tmp_path / "out" / "report.md").read_text()
    with pytest.raises(ValueError, match="diarize backend gives no speaker"):
        A.analyze(recordings, transcribe=b.get("fake"), diarize=lambda rec: b.get("turns")(rec).drop("speaker"))
