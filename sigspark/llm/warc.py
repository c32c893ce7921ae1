"""WARC archives: written with an index, read back by coalesced byte ranges.

``write`` turns rows (id, url, payload) into archives of records, each its own gzip member, and returns the index: file,
offset, length, id, url, payload digest and size, record type. Of records with equal payloads of at least ``least``
bytes the one with the smallest id is a ``response``, the others are ``revisit`` records that refer to it and hold no
payload. ``read`` takes index rows, joins neighbouring ranges of a file into one read, and parses what it finds.

Every task writes archives of its own under a new name into the shared folder and lists in the index only what it has
finished, so a repeated task leaves unlisted files and no wrong entry. Files are opened through pyarrow's file systems
(file, hdfs, s3, gs ...). A record is held whole in memory, an archive never.

Null payload: empty. Null id: written without one; it cannot be referred to, but may revisit. Null url: no target.
Rows that repeat the smallest id are responses each. Control characters in a url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import field, salted_join, stored
from sigspark.session import fresh_dir

CRLF = "\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = [
    field("file", "string"), field("offset", "long"), field("length", "long"), field("id", "long"), field("url", "string"),
    field("digest", "string"), field("size", "long"), field("kind", "string"),
]
RECORD = [
    field("id", "long"), field("payload_bytes", "long"), field("payload_digest", "string"), field("record_type", "string"),
    field("refers_to", "long"), field("url", "string"), field("payload", "binary"),
]


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record(number: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    body = HTTP + payload if refers_to is None else HTTP
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{number} {url} {digest}').urn}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(body),
    }
    if number is not None:
        head["X-Page-ID"] = number
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Page-ID"] = refers_to
    text = "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in head.items()) + CRLF
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + body + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None, str | None, bytes | None]:
    """Fields of ``RECORD`` from one member; the digest of a response is taken from its payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = (line.partition(": ") for line in head.decode().split(CRLF)[1:])
    fields = {k: v for k, _, v in lines}
    body = rest[:int(fields["Content-Length"])]
    number = lambda name: int(fields[name]) if name in fields else None
    kind = fields["WARC-Type"]
    if kind == "revisit":
        payload, size, digest = None, number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    else:
        payload = body.partition(b"\r\n\r\n")[2]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return number("X-Page-ID"), size, digest, kind, number("X-Refers-To-Page-ID"), fields.get("WARC-Target-URI"), payload


def referred(pages: DataFrame, least: int) -> DataFrame:
    """``pages`` (id, url, payload) with ``digest`` and ``refers_to``; payloads themselves are not shuffled twice."""
    rows = pages.withColumn("digest", F.sha2("payload", 256))
    heads = (
        rows.filter(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1 and head is not null").drop("n")
    )
    joined = salted_join(rows, heads, "digest")
    return joined.select("id", "url", "payload", "digest", F.when(~F.col("head").eqNullSafe(F.col("id")), F.col("head")).alias("refers_to"))


def write(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, roll: int = 64 << 20) -> DataFrame:
    """Write archives of about ``roll`` bytes; returns the stored index."""
    root = fresh_dir(pages.sparkSession, "llm-warc")
    source = referred(pages.select(
        F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    ), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = store_of(root)
        system.create_dir(folder, recursive=True)
        names = [f.name for f in INDEX]
        entries: list[tuple] = []
        out, name = None, ""
        for b in batches:
            for number, target, data, digest, head in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                member = record(number, target, data, digest, head)
                kind = "response" if head is None else "revisit"
                entries.append((f"{root}/{name}", out.tell(), len(member), number, target, digest, len(data), kind))
                out.write(member)
                if out.tell() >= roll:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries), KINDS, strict=True)], names=names)
                    entries = []
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries), KINDS, strict=True)], names=names)

    return stored(source.mapInArrow(run, T.StructType(INDEX)), "warc-index")


KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())


def ranges(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """Index rows to byte ranges: records of a file at most ``gap`` apart are read at once, ``most`` bytes at a time."""
    block = F.floor(F.col("offset") / most)
    order = Window.partitionBy("file").orderBy("offset", "length")
    apart = F.col("offset") > F.lag(F.col("offset") + F.col("length")).over(order) + gap
    moved = block != F.lag(block).over(order)
    rows = index.select("file", "offset", "length").withColumn("new", F.coalesce(apart | moved, F.lit(True)).cast("int"))
    runs = rows.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("file", "run").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
    ).drop("run")


def read(index: DataFrame, payloads: bool = True, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records that ``index`` lists, with their payloads if asked for."""
    made = RECORD if payloads else RECORD[:-1]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())[:len(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, stop, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, path = store_of(file)
                with system.open_input_file(path) as source:
                    data = source.read_at(stop - start, start)
                got = [parse(data[r["offset"] - start:r["offset"] - start + r["length"]])[:len(made)] for r in records]
                arrays = [pa.array(c, k) for c, k in zip(zip(*got), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in made])

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // most))                           # by the bytes to read, not by the few rows of the ranges
    return ranges(index, gap, most).repartition(tasks, "file", "start").mapInArrow(run, T.StructType(made))


#: What the registered query returns, in SQL over a table ``pages``.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND head <> page_id THEN head END AS refers_to
FROM m
"""
