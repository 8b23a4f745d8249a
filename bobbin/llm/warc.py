"""WARC archives: a deduplicating writer and a splittable reader.

Writer. Payload digests are grouped (partial counts first); of equal payloads of at least MIN_BYTES the smallest
page_id is the response and the others are revisit records that name it and carry no payload. Each row is decided by its own
digest; digests that hold over a thousandth of all rows are dealt by a salt. Each task writes
one archive of gzip members, one a record, under a temporary name and renames it when it is whole; a task that runs
again writes a file of another name, and the manifest lists the files of the attempts that counted.

Reader. Archives are cut into byte ranges. A task scans its range for the gzip magic, takes a place as a record only
if what it inflates to starts with a WARC version line and a complete header, and owns the records that start inside its
range, reading past the end for the last one. So one large archive is read by many tasks. A header may be of any length. Records lie end
to end, so a place after a record (or at the start) that holds none fails rather than being passed over.

Files go through pyarrow's filesystems by URI (local folders, HDFS, S3, GCS), in the shared folder.

Defined results: a null html is an empty payload; null page_ids are archived as records without an id and read
back as null, and revisit a page with an id if one has their payload, else they are responses; rows that repeat the response's
page_id and payload are responses too; a page_id on two payloads is decided for each; payloads under MIN_BYTES are all
responses; no pages give no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, hot_keys, keep, prepare, shared_dir

MIN_BYTES = 100
#: Bytes in one range of the reader, read at a time, and inflated at a time while a header is validated (it may be of any length).
SPLIT_BYTES, WINDOW, HEADER_BYTES = 8 << 20, 128 << 10, 16 << 10
MAGIC = b"\x1f\x8b\x08"
#: Fixed: the record date, so that archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One gzip member: header block, payload, record end."""
    name = "" if page_id is None else str(page_id)
    kind = "response" if refers_to is None else "revisit"
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]).encode("utf-8", "replace")
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(head + payload + b"\r\n\r\n") + squeeze.flush()


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html and refers_to (null: a response) of each row of `pages`."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").alias("html")).withColumn("d", F.sha2(body, 256))
    each = rows.select("d", "page_id", F.octet_length(body).alias("bytes")).groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    groups = keep(each.where("n > 1"), "digests")
    to = groups.select("d", F.when(F.col("bytes") >= min_bytes, F.col("first")).alias("to"))
    decided = attach(rows, to, "d", "left", heavy=hot_keys(groups, "d", groups, pages.count()), counted=True)
    return decided.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("to")), F.col("to")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives of `pages` into `folder` (the shared one if not given); path and bytes of each."""
    spark = prepare(pages.sparkSession)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    rows = decide(pages, page_id, url, html, min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        ctx = TaskContext.get()
        name = f"{base}/part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, size = None, 0
        for batch in batches:
            for pid, u, h, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (h or "").encode("utf-8", "surrogatepass")
                made = record(pid, u, body if ref is None else b"", hashlib.sha256(body).hexdigest(), len(body), ref)
                out = out or fs.open_output_stream(f"{name}.tmp", compression=None)
                out.write(made)
                size += len(made)
        if out:
            out.close()
            fs.move(f"{name}.tmp", name)
            where = folder.rstrip("/") + "/" + name.rsplit("/", 1)[1]
            yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([size], pa.int64())], names=["path", "bytes"])

    return keep(rows.mapInArrow(write, "path string, bytes long"), "manifest")


class _Range:
    """A file's bytes from `at` on, read a window at a time."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.data = file, at, size, b""

    def more(self) -> bool:
        got = self.file.read_at(min(WINDOW, self.size - self.at - len(self.data)), self.at + len(self.data)) if self.at + len(self.data) < self.size else b""
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def parse_header(head: bytes) -> dict[str, str] | None:
    """Fields of a complete header block (names in lower case), or None."""
    if not re.match(rb"WARC/\d\.\d\r\n", head) or (end := head.find(b"\r\n\r\n")) < 0:
        return None
    fields = {}
    for line in head[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


class _Probe:
    """Whether the gzip member at the front of a range holds a WARC record, told from ever more of its bytes."""

    def __init__(self):
        self.inflate, self.head, self.used = zlib.decompressobj(31), bytearray(), 0

    def look(self, view: bytes) -> bool | None:
        """True or False; None: more bytes are needed to tell. Every byte is inflated once, however long the header is."""
        rest = view[self.used :]
        self.used = len(view)
        while rest and not self.inflate.eof:
            seen = max(0, len(self.head) - 3)
            try:
                self.head += self.inflate.decompress(rest, HEADER_BYTES)
            except zlib.error:
                return False
            rest = self.inflate.unconsumed_tail
            if not b"WARC/".startswith(self.head[:5]):
                return False
            if (end := self.head.find(b"\r\n\r\n", seen)) >= 0:
                return parse_header(bytes(self.head[: end + 4])) is not None
        return False if self.inflate.eof else None


def records_in(uri: str, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, payload) of the records that start in bytes start to end - 1 of an archive."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as file:
        r = _Range(file, start, size)
        due = 0 if start == 0 else None  # where the next record has to start
        while True:
            k = r.data.find(MAGIC)
            if k < 0:
                r.skip(max(0, len(r.data) - 2))
                if r.at < end and r.more():
                    continue
            else:
                r.skip(k)
            if k < 0 or r.at >= end:
                if due is not None and due < min(end, size):
                    raise ValueError(f"{uri}: no record at {due}")
                return
            probe = _Probe()
            while (ok := probe.look(r.data)) is None and r.more():
                pass
            if not ok:
                r.skip(1)
                continue
            inflate, body = zlib.decompressobj(31), bytearray()
            used = 0
            while not inflate.eof:
                if used == len(r.data) and not r.more():
                    raise ValueError(f"{uri}: record at {r.at} is cut off")
                piece = r.data[used:]
                body += inflate.decompress(piece)
                used = len(r.data) - len(inflate.unused_data)
            offset = r.at
            if due not in (None, offset):
                raise ValueError(f"{uri}: no record at {due}")
            due = offset + used
            head = body.find(b"\r\n\r\n") + 4
            fields = parse_header(bytes(body[:head]))
            n = int(fields["content-length"])
            if len(body) < head + n:
                raise ValueError(f"{uri}: record at {offset} is shorter than it says")
            r.skip(used)
            yield offset, fields, bytes(body[head : head + n])


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the archives in `files` (path, bytes): page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest.

    Bytes and digest are of the full payload, for revisits too (their header has both). For responses they are
    computed from what was read, and an archive whose header disagrees fails. Without payloads that column is left out.
    """
    spark = prepare(files.sparkSession)
    splits = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("bytes") - 1), F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = splits.repartition(n, "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                held = 0
                for _, h, body in records_in(path, start, start + split_bytes, size):
                    ident = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
                    digest, length = h["warc-payload-digest"].removeprefix("sha256:"), int(h["x-payload-length"])
                    if h["warc-type"] == "response":
                        length, said, digest = len(body), digest, hashlib.sha256(body).hexdigest()
                        if digest != said:
                            raise ValueError(f"{path}: payload digest differs")
                    rows.append((ident(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], ident(h.get("warc-refers-to", "")), length, digest, *([body] if payloads else [])))
                    held += len(body) * payloads + 200
                    if held > 4 << 20:
                        yield _batch(rows, payloads)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, payloads)

    return spread.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads)


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: 6 + payloads])
