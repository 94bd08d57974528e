"""WARC archives: write records and their index, then read by the index.

Writing happens in the tasks that hold the pages: each task writes one archive of
gzip-compressed records under a name of its own and returns an index row per record. The
index is written before anything is read, so a task that runs twice leaves an archive
that nothing refers to. Reading sorts index rows by file and offset and fetches
neighbouring records in one range.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import new_path, written

MIN_REVISIT_BYTES = 100
#: Record bytes that one reading task is given, about.
TASK_BYTES = 64 << 20
#: Ranges closer than this are fetched together, up to RANGE_BYTES at once.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
INDEX = (
    "page_id long, url string, file string, `offset` long, length long, payload_digest string, "
    "record_type string, refers_to long"
)
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _store(uri: str):
    """(file system, path) of a location that driver and executors share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:] if not uri.startswith("file://") else uri[7:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _safe(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if set(value) & {"\r", "\n"} else value


def _record_id(page_id, digest: str, place: str = "") -> str:
    """The id of a page's record follows from its page's id and payload; where that id is
    null, from its place in the archive."""
    name = f"page:{page_id}:{digest}" if page_id is not None else f"place:{place}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, place: str = "") -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header but no payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest, place)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {_safe(url)}")
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers | {"payload": payload, "payload_bytes": length}


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """Write one record per page under ``folder`` and return the stored index (``INDEX``).

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least
    ``min_revisit_bytes`` the one with the smallest id is a response and the others are
    revisits of it; rows that repeat that smallest id are responses too, as are rows with
    a null id. Record ids follow from page id and payload, so only rows that repeat both
    share one; a null id's record is named by its place. A null url gives a record without a target. Extra columns are not stored;
    an empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # Only digests of repeated payloads are joined; adaptive execution splits a hot one.
    firsts = written(
        base.where((F.octet_length("payload") >= min_revisit_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first"),
        "warc-firsts",
    )
    rows = base.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", F.lower(F.hex("digest")).alias("digest"),
        F.when((F.col("first") != F.col("page_id")), F.col("first")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        at = 0
        store, root = _store(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            offsets, lengths, kinds = [], [], []
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = gzip.compress(record_bytes(page, url, payload, digest, refers, f"{name}:{at}"), 3, mtime=0)
                out.write(data)
                offsets.append(at)
                lengths.append(len(data))
                kinds.append("response" if refers is None else "revisit")
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([name] * len(kinds)), pa.array(offsets, pa.int64()),
                 pa.array(lengths, pa.int64()), batch.column(3), pa.array(kinds), batch.column(4)],
                names=["page_id", "url", "file", "offset", "length", "payload_digest", "record_type", "refers_to"],
            )
        if out is not None:
            out.close()

    index = rows.mapInArrow(write, INDEX).withColumn("folder", F.lit(folder))
    return written(index, "warc-index")


def _ranges(rows: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """[a, b) slices of sorted rows that are fetched in one read."""
    out, a = [], 0
    for i in range(1, len(rows) + 1):
        if i < len(rows):
            (f0, o0, n0), (f1, o1, n1) = rows[i - 1], rows[i]
            near = f0 == f1 and o1 - (o0 + n0) <= GAP_BYTES and o1 + n1 - rows[a][1] <= RANGE_BYTES
            if near:
                continue
        out.append((a, i))
        a = i
    return out


def read_warc(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records that index rows select (``READ``), each checked against its digest. A
    revisit's payload is null; its size and digest come from its headers. Rows are sorted
    by place, so a task reads each archive forwards and in few ranges."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, object] = {}
        for batch in batches:
            folders, names, offsets, lengths = (c.to_pylist() for c in batch.columns)
            rows = list(zip([f"{a}/{b}" for a, b in zip(folders, names, strict=True)], offsets, lengths, strict=True))
            for a, b in _ranges(rows):
                path = rows[a][0]
                if path not in files:
                    for f in files.values():
                        f.close()
                    store, local = _store(path)
                    files = {path: store.open_input_file(local)}
                first = rows[a][1]
                data = files[path].read_at(rows[b - 1][1] + rows[b - 1][2] - first, first)
                found = []
                for _, at, n in rows[a:b]:
                    r = parse_record(zlib.decompress(data[at - first : at - first + n], 31))
                    digest = r["WARC-Payload-Digest"].removeprefix("sha256:")
                    revisit = r["WARC-Type"] == "revisit"
                    if not revisit and (
                        hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["payload_bytes"]
                    ):
                        raise ValueError(f"a record of {path} at {at} does not match its digest")
                    found.append((
                        int(r["X-Page-Id"]) if r["X-Page-Id"] else None, r.get("WARC-Target-URI"),
                        r["payload_bytes"], digest, r["WARC-Type"],
                        int(r["X-Refers-To-Page-Id"]) if revisit else None,
                        None if revisit or not with_payload else r["payload"],
                    ))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)],
                    names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                )

    placed = index.select("folder", "file", "offset", "length")
    # index rows are small, so their bytes would put far too many records into a task
    total = placed.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(int(-(-total // TASK_BYTES)), min(placed.sparkSession.sparkContext.defaultParallelism, int(total >> 20) + 1))
    ordered = placed.repartitionByRange(tasks, "folder", "file", "offset").sortWithinPartitions("folder", "file", "offset")
    return ordered.mapInArrow(read, READ)


