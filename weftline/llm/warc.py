"""WARC archives of captured pages, and their index by external merge."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import new_path, sized

EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
CRLF = b"\r\n"
INDEX = "url_key string, ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
_ARROW = pa.schema([("url_key", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
BATCH = 2048


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder's file system by its own scheme: a local mount, HDFS or an object store."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, in lower case: captures of a site lie together. Null: empty."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return (",".join(reversed(host.split("."))) + ")" + (u.path or "/") + ("?" + u.query if u.query else "")).lower()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, str]]) -> bytes:
    return CRLF.join([b"WARC/1.1", *[f"{k}: {v}".encode() for k, v in fields]]) + CRLF * 2


def _clean(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with the payload, or a revisit without it that names the response."""
    ts = (EPOCH + timedelta(seconds=(page_id or 0) % (10 * 365 * 86400))).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = b"" if revisit else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{_clean(url)}')}>"),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Date", ts),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    return _header(fields) + http + body + CRLF * 2


def write_archives(pages: DataFrame, folder: str, *, roll_bytes: int = 256 << 20) -> DataFrame:
    """Write one record per row as gzip members of ``.warc.gz`` files; returns file, records, bytes.

    Of rows with equal payloads the smallest page_id (by digest) is the response; the others revisit it. Null html is an
    empty payload. A file is written under a name of its task attempt and rolls over at ``roll_bytes``; only
    files that a finished task reports are read, so a lost executor leaves nothing that counts.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", html.alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    slim = pages.select("page_id", F.sha1(html).alias("sha"))
    many = slim.groupBy("sha").agg(F.min("page_id").alias("response_id"), F.count("*").alias("n"), F.count(F.when(F.col("page_id").isNull(), 1)).alias("nulls")).where("n > 1").select("sha", "response_id")
    p = p.join(sized(many, 200_000), "sha", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "sha", "response_id")]
            for i in range(batch.num_rows):
                page_id, url, payload, sha, first = (c[i].as_py() for c in cols)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(path, compression=None), 0, 0
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                revisit = first is not None and page_id != first
                member = z.compress(record(page_id, url, payload, digest, first, revisit)) + z.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= roll_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_pydict({"file": [d[0] for d in done], "records": pa.array([d[1] for d in done], pa.int64()), "bytes": pa.array([d[2] for d in done], pa.int64())}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    return p.mapInArrow(write, "file string, records long, bytes long")


def read_archive(folder: str, file: str) -> Iterator[dict]:
    """Records of one file in order, one in memory at a time; a response's digest and length come from its payload."""
    fs, _ = _fs(folder)
    with fs.open_input_stream(file, compression=None) as src:
        raw, at, pos = src.read(1 << 20), 0, 0
        while raw:
            z, parts = zlib.decompressobj(31), []
            begin = pos
            while True:
                parts.append(z.decompress(raw[at:]))
                if z.eof:
                    used = len(raw) - at - len(z.unused_data)
                    at, pos = at + used, pos + used
                    if at >= len(raw):
                        raw, at = src.read(1 << 20), 0
                    break
                pos += len(raw) - at
                raw, at = src.read(1 << 20), 0
                if not raw:
                    raise OSError(f"{file} ends within a record")
            yield parse(b"".join(parts)) | {"file": file, "offset": begin, "length": pos - begin}


def parse(raw: bytes) -> dict:
    head, _, body = raw.partition(CRLF * 2)
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    payload = body.partition(CRLF * 2)[2]
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda k: int(fields[k]) if fields.get(k) else None
    ts = int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
    return {
        "url_key": url_key(fields["WARC-Target-URI"]),
        "ts": ts,
        "page_id": number("X-Page-Id"),
        "payload_bytes": number("X-Payload-Length") if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest_of(payload),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"),
    }


def _order(r: dict) -> tuple:
    return (r["url_key"], r["ts"], -1 if r["page_id"] is None else r["page_id"], r["file"], r["offset"])


def _write_run(fs: pafs.FileSystem, path: str, rows: Iterator[dict]) -> int:
    """A sorted run as an Arrow file, in batches; returns its length."""
    n, held = 0, []
    with fs.open_output_stream(path) as sink, pa.ipc.new_file(sink, _ARROW) as out:
        def flush() -> None:
            out.write_batch(pa.RecordBatch.from_pylist(held, schema=_ARROW))
        for r in rows:
            held.append(r)
            n += 1
            if len(held) == BATCH:
                flush()
                held = []
        if held:
            flush()
    return n


def _read_run(fs: pafs.FileSystem, path: str, lo: tuple | None, hi: tuple | None) -> Iterator[dict]:
    """Rows of a run with lo <= order < hi; the first batch is found by halving, one batch is in memory."""
    with fs.open_input_file(path) as src:
        run = pa.ipc.open_file(src)
        a, b = 0, run.num_record_batches
        while lo is not None and b - a > 1:
            mid = (a + b) // 2
            if _order(run.get_batch(mid).slice(0, 1).to_pylist()[0]) <= lo:
                a = mid
            else:
                b = mid
        for i in range(a, run.num_record_batches):
            for r in run.get_batch(i).to_pylist():
                key = _order(r)
                if hi is not None and key >= hi:
                    return
                if lo is None or key >= lo:
                    yield r


class LoserTree:
    """k sorted streams as one. Inner nodes keep the loser of their match; after the winner is taken, only the
    matches on its own path are played again, log2(k) comparisons a row."""

    def __init__(self, streams: list[Iterator[dict]], order=_order):
        self.streams, self.order, self.k = streams, order, max(1, len(streams))
        self.head = [self._next(i) for i in range(len(streams))] or [None]
        self.loser = [-1] * self.k
        for i in range(len(self.head)):
            self._play(i)

    def _next(self, i: int):
        row = next(self.streams[i], None)
        return None if row is None else (self.order(row), i, row)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return a is not None and (b is None or a[:2] < b[:2])

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.loser[node]
            if other == -1:
                self.loser[node] = i
                return
            if self._beats(other, i):
                self.loser[node], i = i, other
            node //= 2
        self.loser[0] = i

    def __iter__(self) -> Iterator[dict]:
        while (top := self.head[self.loser[0]]) is not None:
            i = self.loser[0]
            yield top[2]
            self.head[i] = self._next(i)
            self._play(i)


def capture_runs(archives: DataFrame, folder: str, *, run_rows: int = 65536) -> DataFrame:
    """Read archives back; each file gives runs of at most ``run_rows`` captures sorted by (url key, time).
    Returns run path and rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held: list[dict] = []

                def spill() -> pa.RecordBatch:
                    held.sort(key=_order)
                    path = f"{root}/{uuid.uuid4().hex}.run"
                    n = _write_run(fs, path, iter(held))
                    return pa.RecordBatch.from_pydict({"run": [path], "n": pa.array([n], pa.int64())})

                for r in read_archive(folder, file):
                    held.append(r)
                    if len(held) >= run_rows:
                        yield spill()
                        held = []
                if held:
                    yield spill()

    return archives.mapInArrow(read, "run string, n long")


def merged_index(spark, runs: list[str], folder: str, *, ranges: int, fan_in: int = 64, samples: int = 4096) -> DataFrame:
    """All captures in global order, with their ordinal range. Runs beyond ``fan_in`` are first merged in groups,
    pass by pass. The last pass is cut into ranges by sampled captures; each task merges its slice of all
    runs with a loser tree, reading a batch of each at a time, so one hot URL key is cut like any other."""

    def merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        for batch in batches:
            for group in batch.column(0).to_pylist():
                path = f"{root}/{uuid.uuid4().hex}.run"
                _write_run(fs, path, iter(LoserTree([_read_run(fs, r, None, None) for r in group])))
                yield pa.RecordBatch.from_pydict({"run": [path]})

    while len(runs) > fan_in:
        groups = [(runs[i : i + fan_in],) for i in range(0, len(runs), fan_in)]
        todo = spark.createDataFrame(groups, "group array<string>").repartition(len(groups))
        runs = [r["run"] for r in todo.mapInArrow(merge_groups, "run string").collect()]
    fs, _ = _fs(folder)
    picks: list[tuple] = []
    each = max(1, samples // max(1, len(runs)))
    for path in runs:  # at most fan_in runs, ``samples`` single rows in all
        with fs.open_input_file(path) as src:
            run = pa.ipc.open_file(src)
            for i in np.unique(np.linspace(0, run.num_record_batches - 1, min(each, run.num_record_batches)).astype(int)):
                got = run.get_batch(int(i))
                for j in np.unique(np.linspace(0, got.num_rows - 1, max(1, min(got.num_rows, each // run.num_record_batches))).astype(int)):
                    picks.append(_order(got.slice(int(j), 1).to_pylist()[0]))
    picks.sort()
    cuts = sorted({picks[i * len(picks) // ranges] for i in range(1, ranges)}) if picks else []
    spans = list(zip([None, *cuts], [*cuts, None], strict=True))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                held, n = [], 0
                for r in LoserTree([_read_run(fs, p, *spans[k]) for p in runs]):
                    held.append(r | {"part": k, "place": n})
                    n += 1
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema=full)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=full)

    full = _ARROW.append(pa.field("part", pa.int64())).append(pa.field("place", pa.int64()))
    parts = spark.range(len(spans)).repartition(len(spans), "id") if len(spans) > 1 else spark.range(1)
    return parts.mapInArrow(merge, INDEX + ", part long, place long")


def archive(pages: DataFrame, *, folder: str | None = None, ranges: int | None = None) -> DataFrame:
    """Write all pages as archives, read them back and index them: the captures in global order of (url key, time).

    ``part`` and ``place`` number the capture history. Rows come from the bytes of the archives alone. Repeated
    rows are records of their own (with one id, both have the type of that id's first payload rule); an empty
    table gives an empty result; extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    files = [r["file"] for r in write_archives(pages, folder).collect()]  # a row for each file of up to roll_bytes
    n = max(1, len(files))
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(n) if files else spark.createDataFrame([], "file string")
    runs = [r["run"] for r in capture_runs(listed, folder).collect()]
    return merged_index(spark, sorted(runs), folder, ranges=ranges or max(2, min(4096, 2 * n)))
