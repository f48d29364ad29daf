"""WARC archives: write pages as records, read archives back by boundary-chain verification.

Reading: tasks search their files for record magic and emit, for every place that parses, the offset and the offset of
its successor. Pointer jumping from the start of each file (the jump table doubles its stride each round) keeps the
records that the chain reaches; magic inside a payload is not on the chain and is rejected. A chain that does not end at
the last byte of its file raises an error. Headers may have any length.

Records are written by Spark's text writer with the record terminator as line separator, so files are committed by
Spark's own protocol on any file system.

Defined cases: a null html is an empty payload; a null url an empty target; pages with equal payloads and a null page_id
refer to the largest id, or are all responses if there is none; repeated rows are each written (rows with the largest
page_id are all responses); an empty table gives no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.shared import scratch_dir, stored

RECORDS_PER_FILE = 1000
LARGE = 1 << 20  # bytes of a payload that has a file of its own
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
# Magic at the start of a file or behind the end of a record: so each byte belongs to the header of one candidate at most.
MAGIC = re.compile(rb"(?:\A|(?<=\r\n\r\n))WARC/1\.[01]\r\n")
BLANK_LINE = re.compile(rb"\r\n\r\n")
READ_SCHEMA = "file string, at long, next long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four digits for every five hex digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(text), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes (page_id, url, html). Of equal payloads of at least ``min_bytes``, the largest page_id is the response."""
    payload = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    copies = base.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    copies = copies.where((F.col("copies") > 1) & F.col("first").isNotNull()).select("digest", "first")
    joined = base.join(copies.hint("merge"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(F.lit(HTTP_HEAD), F.col("n").cast("string"), F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("payload")))
    refers = F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    lines = [
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        urn(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "),
        url,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        F.when(revisit, refers).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    ]
    parts = [("small", F.col("n") <= LARGE, records_per_file)]
    if not base.where(F.col("n") > LARGE).isEmpty():
        parts.append(("large", F.col("n") > LARGE, 1))
    for name, those, most in parts:
        joined.where(those).select(F.concat(*lines).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(f"{path}/{name}")


def _number(digits: bytes) -> int | None:
    """A long, if the digits are one."""
    return int(digits) if len(digits) < 20 and -(2**63) <= int(digits) < 2**63 else None


def _record(data: memoryview, at: int) -> tuple[int, int, dict[bytes, bytes]] | None:
    """Start and end of the block of the record at an offset, and its header's fields, if the header parses."""
    end = BLANK_LINE.search(data, at)
    if not end:
        return None
    fields = {}
    for line in bytes(data[at : end.start()]).split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    size = _number(length) if length.isdigit() else None
    if size is None or end.end() + size > len(data):
        return None
    return end.end(), end.end() + size, fields


def _content(data: memoryview, start: int, stop: int, fields: dict[bytes, bytes]) -> tuple:
    """Type, page, page referred to, payload bytes and payload digest of a record."""
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    ids = [re.search(rb"urn:page:(-?\d+)", fields.get(k, b"")) for k in (b"warc-record-id", b"warc-refers-to")]
    block = data[start:stop]
    cut = BLANK_LINE.search(block)
    size = digest = None
    if kind == "response" and cut:
        payload = block[cut.end() :]
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif kind == "revisit":
        said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block[: cut.start() + 2] if cut else block)
        size = _number(said[1]) if said else None
        digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
    return kind, *[_number(m[1]) if m else None for m in ids], size, digest


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place with record magic that parses, with its successor's offset, and a row "end" for the end of each file.

    Contents are read (and hashed) of candidates that do not begin inside one read before, so each byte is hashed once at
    most; a chain from the file's start has no others.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                rows, free = [], 0
                for m in MAGIC.finditer(data):
                    found, content = _record(data, m.start()), (None,) * 5
                    if found:
                        if m.start() >= free:
                            content, free = _content(data, *found), found[1]
                        rows.append((name, m.start(), found[1] + 4, *content))
                rows.append((name, len(data), None, "end", None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(find, READ_SCHEMA)


def reachable(records: DataFrame) -> DataFrame:
    """(file, at) of the records on the chain of successors from each file's start.

    Round k joins what is reached with the 2^k-step jump table; the largest file's number of candidates, which the
    driver asks for, gives the number of rounds.
    """
    most = records.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    jump = records.select("file", "at", "next")
    reached = records.where("at = 0").select("file", "at")
    for k in range(max(0, most - 1).bit_length()):
        step = reached.join(jump.hint("merge"), ["file", "at"], "left")
        reached = step.select("file", F.explode(F.array_compact(F.array("at", "next"))).alias("at"))
        a, b = jump.alias("a"), jump.alias("b")
        longer = a.join(b.hint("merge"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.at")))
        jump = stored(longer.select("a.file", "a.at", "b.next"), f"jump{k}")
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the verified response and revisit records."""
    found = stored(candidates(spark, path), "candidates")
    reached = stored(reachable(found), "reached")
    broken = found.where("record_type = 'end'").join(reached.hint("merge"), ["file", "at"], "left_anti").first()
    if broken:
        raise ValueError(f"the records of {broken['file']} do not lead to its end at byte {broken['at']}")
    live = found.join(reached.hint("merge"), ["file", "at"], "left_semi")
    return live.where(F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back."""
    path = scratch_dir(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
s as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as x, max(page_id) over (partition by h) as first, count(*) over (partition by h) as n from p),
b as (select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest from s)
select page_id, payload_bytes, payload_digest,
  case when n > 1 and page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when n > 1 and page_id is distinct from first and first is not null then first end as refers_to
from b
"""
