"""WARC archives: written by tasks, indexed first, read back by coalesced byte ranges.

Each task writes archives of its own into a shared folder (one gzip member per record, a new file after `roll_bytes`) and
returns one index row per record: file, offset, length, URL and digest. File names are new for each attempt, and only the
rows of the attempt that succeeded reach the index, so a task that is run again leaves no wrong record behind. Reading
sorts the index rows of the selected records by file and offset and merges neighbouring ranges into one read.

The folder is any URI that pyarrow's file systems open on every executor (`file:`, `hdfs:`, `s3:`, …).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path

ROLL_BYTES, RANGE_BYTES, RANGE_GAP = 64 << 20, 4 << 20, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    """A header value on one line; control characters are written as %XX."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m.group()):02X}", value or "")


def _plain(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head only."""
    digest = payload_digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
             "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The row of RECORDS that a record's bytes stand for; `intact` tells whether block and digest agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    response = field["WARC-Type"] == "response"
    number = lambda k: int(field[k]) if k in field else None
    return {"page_id": number("X-Page-ID"), "url": _plain(field["WARC-Target-URI"]) if "WARC-Target-URI" in field else None,
            "record_type": field["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload_bytes": full, "payload_digest": digest,
            "payload": payload if response else None,
            "intact": payload_digest(block) == field["WARC-Block-Digest"].removeprefix("sha1:") and (
                not response or (len(payload) == full and payload_digest(payload) == digest))}


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of at least *least_bytes* bytes, the largest page_id is kept.

    Payloads are equal when their SHA-256 is. `refers_to` is NULL for a response. Rows that share the largest id of a
    group, and groups without any id, are all responses. A NULL html is an empty payload.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("key", F.sha2("html", 256))
    keep = rows.filter(F.octet_length("html") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    first = F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))
    return rows.join(keep.select("key", "last"), "key", "left").select("page_id", "url", "html", first.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Write (page_id, url, html, refers_to) as archives below *folder*; the index, itself a table in that folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        out, name, offset = None, "", 0
        for batch in batches:
            index = {k: [] for k in ("file", "offset", "length", "page_id", "url", "digest", "record_type")}
            for row in batch.to_pylist():
                if out is None or offset >= roll_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = row["html"].encode("utf-8", "surrogatepass")
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = gz.compress(record_bytes(row["page_id"], row["url"], payload, row["refers_to"])) + gz.flush()
                out.write(data)
                for k, v in zip(index, (name, offset, len(data), row["page_id"], row["url"], payload_digest(payload),
                                        "response" if row["refers_to"] is None else "revisit")):
                    index[k].append(v)
                offset += len(data)
            yield _batch(index)
        if out is not None:
            out.close()

    store, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(root, recursive=True)
    marked.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return marked.sparkSession.read.parquet(f"{folder}/index")


_KINDS = {"offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(),
          "payload": pa.binary(), "intact": pa.bool_()}


def _batch(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, _KINDS.get(k, pa.string())) for k, v in cols.items()})


def coalesce_ranges(rows: list[tuple[int, int]], gap: int = RANGE_GAP, most: int = RANGE_BYTES) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) to (first byte, last byte + 1, number of rows): near neighbours in one range of *most* bytes.

    A record longer than *most* is a range of its own."""
    out: list[list[int]] = []
    for offset, length in rows:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1][1:] = [max(out[-1][1], offset + length), out[-1][2] + 1]
        else:
            out.append([offset, offset + length, 1])
    return [tuple(r) for r in out]


def read_records(index: DataFrame, folder: str, with_payload: bool = True, gap: int = RANGE_GAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of RECORDS for the index rows given (filter the index to select records).

    An archive is at most `roll_bytes` and a record long, so the rows of one file are a bounded group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        name, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(files):
                end = at
                while end < len(files) and files[end] == files[at]:
                    end += 1
                if files[at] != name:
                    name, source = files[at], store.open_input_file(f"{root}/{files[at]}")
                for first, last, n in coalesce_ranges(list(zip(offsets[at:end], lengths[at:end])), gap, range_bytes):
                    data = source.read_at(last - first, first)
                    found = {k.split()[0]: [] for k in RECORDS.split(", ")}
                    for i in range(at, at + n):
                        row = parse_record(zlib.decompress(data[offsets[i] - first:offsets[i] - first + lengths[i]], 31))
                        for k in found:
                            found[k].append(row[k] if with_payload or k != "payload" else None)
                    yield _batch(found)
                    at += n

    rows = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(run, RECORDS)


def archive_and_read(pages: DataFrame, folder: str | None = None, with_payload: bool = True) -> DataFrame:
    """Write every row of *pages* as a record and read all records back; see `mark_revisits` for the rules."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(mark_revisits(pages), folder), folder, with_payload)
