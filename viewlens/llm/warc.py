"""WARC archives as a chunked record table.

An archive is a table of ``(shard, record, chunk, last, data, running)``
rows: the ``data`` of a shard's rows, in order of record and chunk, is a
WARC/1.1 file. An oversized payload is many chunk rows, cut as views of the
source buffer; ``running`` is the SHA-1 of the payload up to the end of the
chunk, so that a reader can check and resume at any chunk without holding
the record.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import land, shuffle_partitions

#: Payload bytes in a chunk row, and rows in an output batch (by bytes).
CHUNK = 1 << 18
BATCH = 8 << 20
#: Copies of a payload's hash, so that no payload is one join partition.
SALT = 32

TABLE = "record string, chunk int, last boolean, data binary, running binary"
_SCHEMA = pa.schema([("record", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()),
                     ("data", pa.binary()), ("running", pa.binary())])
RESPONSE, REVISIT = "response", "revisit"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _int(v) -> str:
    return "" if v is None else str(v)


def header(kind: str, record: str, uri: str, size: int, digest: str, refers: str | None, body: int) -> bytes:
    """WARC and HTTP header of a record; ``body`` payload bytes follow."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(uri.split())}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == REVISIT:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(http) + body}"]).encode() + b"\r\n\r\n" + http


def records(pages: DataFrame, smallest: int = 0, id_col: str = "page_id", payload: str = "html",
            uri: str = "url") -> DataFrame:
    """``pages`` with ``refers_to``: null for responses, for a revisit the
    smallest id of the equal payloads of at least ``smallest`` bytes.

    Null payloads are empty ones. Rows that repeat the smallest id are all
    responses. A null id is a response and is referred to only where no
    other id has the payload (then as null, so those rows are responses).
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri).alias("uri"), body.alias("body"))
    page = page.withColumn("sha", F.sha1(F.encode("body", "utf-8")))
    many = page.where(F.octet_length("body") >= smallest).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("sha", "first")
    many = land(many, "repeated").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64("page_id", "uri"), F.lit(SALT)).cast("int")
    found = page.withColumn("salt", salt).join(many, ["sha", "salt"], "left")
    refers = F.when((F.octet_length("body") >= smallest) & (F.col("page_id") != F.col("first")), F.col("first"))
    return found.select("page_id", "uri", "body", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, chunk: int = CHUNK, **kw) -> None:
    """Write one record for each row of ``pages`` to the archive ``path``.
    A failed task leaves nothing: files appear when the job commits."""
    def run(batches):
        out, size, number = [], 0, 0
        for b in batches:
            ids, uris, refers = (b.column(c).to_pylist() for c in ("page_id", "uri", "refers_to"))
            bodies = b.column("body")
            for i, page in enumerate(ids):
                view = memoryview(bodies[i].as_buffer())
                sums, at = [], 0
                sha = hashlib.sha1()
                while at < len(view) or not sums:
                    sha.update(view[at: at + chunk])
                    at += chunk
                    sums.append(sha.copy().digest())
                kind = RESPONSE if refers[i] is None else REVISIT
                parts = [view[a: a + chunk] for a in range(0, len(view), chunk)] if kind == RESPONSE else []
                parts = parts or [b""]
                head = header(kind, _int(page), uris[i] or "", len(view), b32(sums[-1]),
                              None if refers[i] is None else str(refers[i]), len(view) if kind == RESPONSE else 0)
                name = f"{_int(page)}:{number}"
                number += 1
                for k, part in enumerate(parts):
                    last = k == len(parts) - 1
                    data = (head if k == 0 else b"") + bytes(part) + (b"\r\n\r\n" if last else b"")
                    out.append((name, k, last, data, sums[-1] if last else sums[k]))
                    size += len(data)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], schema=_SCHEMA)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], schema=_SCHEMA)

    rows = records(pages, **kw).select("page_id", "uri", F.encode("body", "utf-8").alias("body"), "refers_to")
    table = rows.mapInArrow(run, TABLE).select(F.spark_partition_id().alias("shard"), "*")
    # payloads are text: compressed, they are about a third
    table.write.option("compression", "zstd").parquet(path)


def parse(head: bytes) -> tuple[dict[str, str], int, int]:
    """WARC header fields, the offset of the payload and the payload size
    that the HTTP header states."""
    end = head.index(b"\r\n\r\n") + 4
    fields = dict(line.split(": ", 1) for line in head[:end].decode().split("\r\n")[1:] if ": " in line)
    start = head.index(b"\r\n\r\n", end) + 4
    http = dict(line.split(": ", 1) for line in head[end:start].decode().split("\r\n")[1:] if ": " in line)
    return fields, start, int(http["Content-Length"])


def read(spark, path: str) -> DataFrame:
    """One row for each record of the archive: page_id, payload_bytes,
    payload_digest, record_type, refers_to, uri. The payload of a response
    is hashed anew from its chunks, in order, one chunk at a time, and each
    chunk's running digest is compared; a digest or length that differs from
    the table's or the header's raises ``ValueError``."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"]

    def run(batches):
        sha = fields = None
        left = size = 0
        for b in batches:
            out = []
            data, running = b.column("data"), b.column("running").to_pylist()
            for i, (chunk, last) in enumerate(zip(b.column("chunk").to_pylist(), b.column("last").to_pylist())):
                view = memoryview(data[i].as_buffer())
                at = 0
                if chunk == 0:
                    fields, at, size = parse(bytes(view))
                    sha, left = hashlib.sha1(), size if fields["WARC-Type"] == RESPONSE else 0
                part = view[at: len(view) - 4 if last else len(view)]
                sha.update(part)
                left -= len(part)
                whole = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                if running[i] != (sha.digest() if fields["WARC-Type"] == RESPONSE else whole):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']}, chunk {chunk}")
                if last:
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if left or kind == RESPONSE and b32(sha.digest()) != said:
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    ident = lambda k: fields[k].removeprefix("<urn:page:").removesuffix(">") if k in fields else ""
                    page, to = ident("WARC-Record-ID"), ident("WARC-Refers-To")
                    out.append((int(page) if page else None, size, said, kind, int(to) if to else None,
                                fields.get("WARC-Target-URI", "")))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    table = spark.read.schema("shard int, " + TABLE).parquet(path)
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, uri string")
    one = table.where("chunk = 0 and last").mapInArrow(run, schema)
    # the chunks of an oversized record may lie in several splits of a file
    long = table.where("not (chunk = 0 and last)")
    n = shuffle_partitions(spark)
    many = long.repartition(n, "shard", "record").sortWithinPartitions("shard", "record", "chunk").mapInArrow(run, schema)
    return one.union(many)
