"""WARC archives of pages and their chunked record table.

Each task writes one archive (WARC/1.1, one record per page); the payload goes out in chunks of a view on the
row's buffer, without a copy.  A record's identifier names its page, its archive and its number there, so that
records of repeated page_ids can be told apart; a revisit refers to the page.  Reading streams an archive and yields rows of at most CHUNK payload bytes: record
identifier, chunk number, the bytes, the bytes up to here and the SHA-1 of all bytes up to here; the last chunk's
digest is the payload's and is compared with the record's header.  No record is ever held whole when reading.

Of records whose payloads are equal and at least ``min_bytes`` long, that of the smallest page_id is a response,
the others are revisits of it.

Defined results: a null html is an empty payload; rows that repeat the smallest page_id of a payload are all
responses; a null page_id counts as larger than all (its payload's smallest is another's, if there is one); a null
url leaves the target out; an empty table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import files
from marquee.llm.common import pick, pin, shared_path

CHUNK = 1 << 18
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_ROWS = "page_id long, record string, record_type string, refers_to long, chunk long, length long, bytes_so_far long, digest_so_far string, last boolean, payload binary"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def page_urn(page_id: int | None, place: str = "") -> str:
    """A page's name, and with its place (archive, number in it) that of one record of it."""
    return f"<urn:page:{'' if page_id is None else page_id}{place}>"


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    return int(number) if number else None


def heads(page_id, place: str, url, digest: str, n_bytes: int, refers_to) -> bytes:
    """The WARC head and the HTTP head of a record; a revisit has no payload after them."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id, place)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {page_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n_bytes)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def first_of_payload(pages: DataFrame, min_bytes: int) -> DataFrame:
    """digest, first: the payloads that several pages share, with the smallest page_id."""
    shared = pages.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return pin(shared.where("n > 1").select("digest", "first"), "payloads")


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages (page_id, url, html) as WARC files; returns path and records."""
    folder = shared_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    known = rows.join(first_of_payload(rows.select("page_id", "digest", "n_bytes"), min_bytes), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    known = known.select("page_id", "url", "digest", "n_bytes", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path, out, n = f"{folder}/part-{part:06d}.warc", None, 0
        for batch in batches:
            for page_id, url, digest, n_bytes, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5), strict=True):
                out = out or files.Writer(path)
                out.write(heads(page_id, f":{part}:{n}", url, base32(digest), n_bytes, refers_to))
                if refers_to is None:
                    view = memoryview(payload.as_buffer())
                    for i in range(0, n_bytes, CHUNK):
                        out.write(view[i : i + CHUNK])
                out.write(b"\r\n\r\n")
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return pin(known.mapInArrow(write, "path string, records long"), "archives")


def _head(f: io.BufferedReader) -> list[bytes]:
    lines = []
    while (line := f.readline()) not in (b"\r\n", b""):
        lines.append(line.rstrip(b"\r\n"))
    return lines


def read_chunks(path: str, size: int = CHUNK) -> Iterator[tuple]:
    """The rows of CHUNK_ROWS of one archive, in order."""
    fs, name = files.opened(path)
    with fs.open_input_stream(name) as raw, io.BufferedReader(raw, 1 << 18) as f:
        while lines := _head(f):
            if lines[0] != b"WARC/1.1":
                raise ValueError(f"{path}: no record where one should begin")
            head = dict(x.decode().split(": ", 1) for x in lines[1:])
            http = _head(f)
            n_bytes = int(next(x for x in http if x.startswith(b"Content-Length: "))[16:])
            record = head["WARC-Record-ID"]
            page_id, kind, refers_to = page_of(record), head["WARC-Type"], page_of(head.get("WARC-Refers-To"))
            declared = head["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "revisit":
                yield page_id, record, kind, refers_to, 0, 0, n_bytes, declared, True, b""
            else:
                sha, so_far, k = hashlib.sha1(), 0, 0
                while True:
                    data = f.read(min(size, n_bytes - so_far))
                    sha.update(data)
                    so_far += len(data)
                    last = so_far == n_bytes
                    digest = base64.b32encode(sha.digest()).decode()
                    if (last and digest != declared) or not (data or last):
                        raise ValueError(f"{path}: the payload of {record} does not have its digest")
                    yield page_id, record, kind, None, k, len(data), so_far, digest, last, data
                    k += 1
                    if last:
                        break
            f.read(4)


def chunk_table(archives: DataFrame, size: int = CHUNK) -> DataFrame:
    """CHUNK_ROWS of all archives (path, records), an archive to a task."""
    names = [x.split()[0] for x in CHUNK_ROWS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.bool_(), pa.binary()]

    def made(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in read_chunks(path, size):
                    rows.append(row)
                    held += row[5] + 200
                    if held >= 1 << 22:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    tasks = archives.select("path").repartitionByRange(max(1, archives.count()), "path")
    return tasks.mapInArrow(load, CHUNK_ROWS)


def records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from the last chunk of each record."""
    return chunks.where("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
