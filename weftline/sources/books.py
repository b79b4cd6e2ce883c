"""Books as chapter rows: HTML, EPUB, plain text and pages of a PDF."""

from __future__ import annotations

import io
import posixpath
import wave
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.text import clean_text

#: Shortest text of an EPUB item, longest page title, tags in the order in which a title is sought.
MIN_ITEM, MAX_TITLE, TITLE_TAGS = 50, 120, ("h1", "h2", "h3")
REPLACEMENT = "�"


class _Text(HTMLParser):
    """Pieces of text without scripts and styles, and the first text of each heading tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.titles: dict[str, list[str]] = {}
        self.open: list[str] = []
        self.done: set[str] = set()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style") or tag in (*TITLE_TAGS, "title"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            self.done.add(tag)

    def handle_data(self, data):
        if any(t in ("script", "style") for t in self.open) or not data.strip():
            return
        self.pieces.append(data.strip())
        for t in self.open:
            if t not in self.done:
                self.titles.setdefault(t, []).append(data.strip())


def read_html(html: str) -> tuple[str, str | None]:
    """Text with blanks between its pieces, and the title (first heading, else a short page title)."""
    p = _Text()
    p.feed(html)
    p.close()
    text = " ".join(p.pieces).replace(REPLACEMENT, "")
    for tag in TITLE_TAGS:
        title = " ".join(p.titles.get(tag, [])).replace(REPLACEMENT, "").strip()
        if title:
            return text, title
    title = " ".join(p.titles.get("title", [])).replace(REPLACEMENT, "").strip()
    return text, title if 0 < len(title) < MAX_TITLE else None


def _epub_items(content: bytes) -> Iterator[tuple[str, str]]:
    """(file name, HTML) of an EPUB's documents: those of the spine in order, then the rest."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in box.iter() if e.tag.endswith("rootfile"))
        root, base = ET.fromstring(z.read(opf)), posixpath.dirname(opf)
        items = {e.attrib["id"]: e.attrib for e in root.iter() if e.tag.endswith("}item") or e.tag == "item"}
        pages = {k: v["href"] for k, v in items.items() if "html" in v.get("media-type", "")}
        spine = [e.attrib["idref"] for e in root.iter() if e.tag.endswith("itemref")]
        order = [k for k in dict.fromkeys(spine) if k in pages]
        for k in order + [k for k in pages if k not in order]:
            name = posixpath.join(base, pages[k])
            yield name, z.read(name).decode("utf-8", errors="replace")


def epub_chapters(files: DataFrame) -> DataFrame:
    """Chapters of EPUB files, (path, content binary) as ``binaryFile`` gives them: path, idx, title, content, error.
    Items of little text take no number. An unreadable or empty archive is one row with an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                found, error = [], None
                try:
                    for name, html in _epub_items(bytes(content)):
                        text, title = read_html(html)
                        if len(text) >= MIN_ITEM:
                            stem = posixpath.splitext(posixpath.basename(name))[0].replace("_", " ").strip()
                            found.append((path, len(found), title or stem or "Chapter", text, None))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration) as e:
                    error = f"cannot open EPUB: {type(e).__name__}"
                out += found or [(path, None, None, None, error or "EPUB contains no extractable text")]
            yield pd.DataFrame(out, columns=["path", "idx", "title", "raw", "error"]).astype({"idx": "Int64"})

    got = files.select("path", "content").mapInPandas(parse, "path string, idx long, title string, raw string, error string")
    return got.select("path", "idx", "title", clean_text(F.col("raw")).alias("content"), "error")


def html_text(html) -> F.Column:
    from pyspark.sql import types as T

    from weftline.operators.text import mapped

    return mapped(lambda x: read_html(x)[0], T.StringType())(html)


def text_of(content: Column) -> Column:
    """Bytes as UTF-8; those that aren't become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def read_text_books(spark: SparkSession, path: str) -> DataFrame:
    """Plain texts, a file a book of one chapter."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.lit(0).alias("idx"), text_of(F.col("content")).alias("content"))


#: What extracts the pages and the metadata (title, author, subject) of one PDF's bytes.
Extractor = Callable[[bytes], tuple[list[str], dict[str, str]]]


def _installed(content: bytes) -> tuple[list[str], dict[str, str]]:
    """By whichever optional PDF library is there."""
    try:
        import fitz
    except ImportError as e:
        raise NotImplementedError("a PDF needs a text extractor: install one or pass ``extract``") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        return [page.get_text("text") for page in doc], {k: v or "" for k, v in (doc.metadata or {}).items()}


def pdf_pages(files: DataFrame, extract: Extractor | None = None) -> DataFrame:
    """Pages of PDF files, (path, content binary): path, page_no (from 1), text, num_pages, title, author, subject, error. A title that isn't there is made of
    the file's name. A file that can't be read, or without any text, is one row with an error."""
    get = extract or _installed

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    pages, meta = get(bytes(content))
                except NotImplementedError:
                    raise
                except Exception as e:  # whatever a PDF library raises on a broken file
                    out.append((path, None, None, None, None, None, None, f"cannot open PDF: {type(e).__name__}"))
                    continue
                stem = posixpath.splitext(posixpath.basename(path))[0]
                about = ((meta.get("title") or "").strip() or stem.replace("_", " ").replace("-", " ").title(), (meta.get("author") or "").strip(), (meta.get("subject") or "").strip())
                some = [(path, i, text, len(pages), *about, None) for i, text in enumerate(pages, 1) if text.strip()]
                out += some or [(path, None, None, len(pages), *about, f"PDF contains no extractable text ({len(pages)} pages)")]
            yield pd.DataFrame(out, columns=["path", "page_no", "text", "num_pages", "title", "author", "subject", "error"]).astype({"page_no": "Int64", "num_pages": "Int64"})

    return files.select("path", "content").mapInPandas(parse, "path string, page_no long, text string, num_pages long, title string, author string, subject string, error string")


def pdf_chapters(files: DataFrame, extract: Extractor | None = None) -> DataFrame:
    """Chapters of PDF files: path, idx, title, content, page_start, page_end, error."""
    pages = pdf_pages(files, extract)
    good = pages_to_chapters(pages.where("error is null").select(F.col("path").alias("doc_id"), "page_no", "text"))
    bad = pages.where("error is not null").select("path", *[F.lit(None).cast(t).alias(c) for c, t in (("idx", "long"), ("title", "string"), ("content", "string"), ("page_start", "long"), ("page_end", "long"))], "error")
    return good.select(F.col("doc_id").alias("path"), "idx", "title", "content", "page_start", "page_end", F.lit(None).cast("string").alias("error")).unionByName(bad)


def reader_of(path: Column) -> Column:
    """The reader that a file's ending asks for: epub, txt, and pdf for anything else."""
    ending = F.lower(F.substring_index(path, ".", -1))
    return F.when(ending.isin("epub", "txt"), ending).otherwise("pdf")


def read_books(spark: SparkSession, path: str, *, extract: Extractor | None = None) -> DataFrame:
    """Chapters of all books below ``path`` (a file, a folder or a pattern), each by its file's ending: path, idx, title, content, error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", reader_of(F.col("path")).alias("reader"))
    of = lambda kind: files.where(F.col("reader") == kind).select("path", "content")
    nothing = F.lit(None).cast("string")
    texts = of("txt").select("path", F.lit(0).cast("long").alias("idx"), nothing.alias("title"), text_of(F.col("content")).alias("content"), nothing.alias("error"))
    out = epub_chapters(of("epub")).unionByName(texts)
    if of("pdf").isEmpty():
        return out
    return out.unionByName(pdf_chapters(of("pdf"), extract).select(*out.columns))


def pages_to_chapters(pages: DataFrame) -> DataFrame:
    """Chapters of (doc_id, page_no, text): blank pages are skipped; a chapter knows the page of its heading (page_start) and of the next one (page_end)."""
    from weftline.operators.text import split_chapters

    some = pages.where(~F.col("text").rlike(r"(?U)^\s*$"))
    lines = some.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return split_chapters(lines.select("doc_id", F.struct("page_no", "k").alias("n"), "line", "page_no"))


def wav_samples(files: DataFrame) -> DataFrame:
    """Rate, channels and samples of 16-bit WAV files (path, content); others have an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(bytes(content))) as w:
                        if w.getsampwidth() != 2:
                            raise wave.Error(f"{8 * w.getsampwidth()} bits a sample; 16 are read")
                        out.append((path, w.getframerate(), w.getnchannels(), np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(int).tolist(), None))
                except (wave.Error, EOFError) as e:
                    out.append((path, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "rate", "channels", "samples", "error"]).astype({"rate": "Int64", "channels": "Int64"})

    return files.select("path", "content").mapInPandas(parse, "path string, rate long, channels long, samples array<int>, error string")
