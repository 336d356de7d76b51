"""WARC archives with an index first: written per partition, read back by coalesced byte ranges.

``write_archives`` writes each partition to an archive of gzip members, one a record, and returns an index with file,
offset, length, URL, digest, record type and id. ``read_records`` takes any selection of index rows, sorts them by file
and offset, joins neighbouring ranges into single reads, and parses the records.

An archive is named for its task attempt, and only index rows of the attempt that Spark commits name it: what a lost
executor wrote is never read. Archives lie in a shared folder, opened through Arrow's file systems.

Defined cases: a null payload is empty; payloads below ``least_revisit`` bytes are always responses, also if equal; null
URLs are written as ``urn:none``; what a URL may not hold is percent-encoded; repeated rows are separate records, and
those of the largest page_id of their payload are all responses; rows without a page_id revisit any that has one.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shipping import ship
from tallyhouse.session import arrow_uri, scratch_path, stage

LEAST_REVISIT = 1000

#: Neighbouring ranges are read at once if no more bytes lie between them, up to the most bytes of one read.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20

#: Archived bytes that one reading task takes on.
TASK_BYTES = 32 << 20

#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "file string, offset long, length long, url string, digest string, record_type string, page_id long"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id, url, payload: bytes, sha1: bytes, refers_to, revisit: bool) -> bytes:
    """One record: header, HTTP header, and the payload unless it is a revisit."""
    target = quote(url or "urn:none", safe=";/?:@&=+$,#%[]!~*'()-_.")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{b32encode(sha1).decode()}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields of a record by lower-case name, its HTTP header and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields | {"http": http.decode(), "payload": payload}


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages with payload, its size and digests, and ``refers_to``: the response that a revisit refers to.

    The response of equal payloads is that of the largest page_id; it is found by a partial maximum per payload before
    the shuffle, and the join's hot payloads can be split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_key"),
    )
    large = F.col("payload_bytes") >= least
    best = (
        sized.filter(large)
        .select("payload_key", "page_id")
        .groupBy("payload_key")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )
    # read back, so that the join's own exchange lets hot payloads be split
    return sized.join(stage(best, "responses"), "payload_key", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archive ``mark_revisits`` rows below ``folder``; returns the index, written there too."""
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, offset = None, "", 0
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    task = TaskContext.get()
                    name = f"{folder}/archive-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
                    system, path = pafs.FileSystem.from_uri(arrow_uri(name))
                    out = system.open_output_stream(path, compression=None)
                    path = name
                rows = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = payload or b""
                    digest = hashlib.sha1(payload).digest()
                    revisit = refers_to is not None
                    member = gzip.compress(_record(page_id, url, payload, digest, refers_to, revisit), 1, mtime=0)
                    out.write(member)
                    kind = "revisit" if revisit else "response"
                    rows.append((path, offset, len(member), url, digest.hex(), kind, page_id))
                    offset += len(member)
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                names = ["file", "offset", "length", "url", "digest", "record_type", "page_id"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        finally:
            if out is not None:
                out.close()

    pages.select("page_id", "url", "payload", "refers_to").mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted (file, offset, length) rows in groups that one read covers."""
    group: list[tuple[str, int, int]] = []
    for row in rows:
        if group:
            file, offset, length = group[-1]
            near = row[0] == file and row[1] - offset - length <= GAP_BYTES
            if not near or row[1] + row[2] - group[0][1] > READ_BYTES:
                yield group
                group = []
        group.append(row)
    if group:
        yield group


RECORD_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
    "payload binary"
)


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows, in tasks that each read a stretch of sorted ranges."""
    ship(selected.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name = None, None
        for batch in batches:
            for group in _ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if group[0][0] != name:
                    name = group[0][0]
                    system, path = pafs.FileSystem.from_uri(arrow_uri(name))
                    source = system.open_input_file(path)
                first = group[0][1]
                data = source.read_at(group[-1][1] + group[-1][2] - first, first)
                found = []
                for _, offset, length in group:
                    raw = zlib.decompress(data[offset - first : offset - first + length], wbits=31)
                    found.append(_as_row(parse_record(raw), with_payload))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
                columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    columns = ["file", "offset", "length"]
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, -(-size // TASK_BYTES))
    sorted_ranges = selected.select(*columns).repartitionByRange(tasks, *columns[:2]).sortWithinPartitions(*columns[:2])
    return sorted_ranges.mapInArrow(read, RECORD_SCHEMA)


def _as_row(record: dict, with_payload: bool) -> tuple:
    sha1 = b32decode(record["warc-payload-digest"].removeprefix("sha1:"))
    size = int(re.search(r"(?m)^Content-Length: (\d+)", record["http"]).group(1))
    payload = record["payload"]
    if record["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != sha1):
        raise ValueError(f"payload of {record['warc-record-id']} differs from its digest")
    number = lambda urn: int(n) if (n := urn.removeprefix("<urn:page:").removesuffix(">")) else None
    return (
        number(record["warc-record-id"]),
        size,
        sha1.hex(),
        record["warc-type"],
        number(record["warc-refers-to"]) if "warc-refers-to" in record else None,
        record["warc-target-uri"],
        payload if with_payload else None,
    )


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Archive all pages, then read every record back."""
    index = write_archives(mark_revisits(pages, least), scratch_path(ship(pages.sparkSession), "warc"))
    return read_records(index, with_payload=False).drop("payload")
