"""WARC records as a chunked record table.

An archive is a table of chunks: (record_id, chunk_no, data, ...). The data of a
record's chunks, in order, are the bytes of one WARC record: the header block,
the payload, and the closing blank lines. A payload longer than a chunk is cut,
so no reader or writer holds more than one chunk besides its input cell, and each
chunk carries the SHA-256 of the payload up to its end: a reader can verify a
prefix, resume, and needs no second pass for the whole digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.staging import staged

CHUNK_BYTES = 64 << 10
#: Payloads under this many bytes are never stored as revisits.
MIN_SHARED = 100
#: Bytes of chunk data that a task gathers before it hands them on.
_FLUSH = 4 << 20

CHUNKS = "record_id long, chunk_no int, chunk_end boolean, header_bytes int, data binary, running_digest string"


def header(record_type: str, page_id, url: str | None, digest: str, length: int, refers_to) -> bytes:
    """Header block of a record, with its closing blank line."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {length}",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {0 if record_type == 'revisit' else length}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _chunks(record_id, page_id, url, payload: bytes, digest: str, length: int, refers_to, chunk_bytes: int):
    kind = "response" if refers_to is None else "revisit"
    head, body = header(kind, page_id, url, digest, length, refers_to), memoryview(payload if kind == "response" else b"")
    running, no = hashlib.sha256(), 0
    for at in range(0, max(1, len(body)), chunk_bytes):
        piece, last = body[at : at + chunk_bytes], at + chunk_bytes >= len(body)
        running.update(piece)
        data = (head if no == 0 else b"") + bytes(piece) + (b"\r\n\r\n" if last else b"")
        yield record_id, no, last, len(head) if no == 0 else 0, data, running.hexdigest()
        no += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.string())
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One WARC record a row of ``pages``, as a staged chunk table.

    Of payloads of at least ``MIN_SHARED`` bytes that are equal, the one with the
    smallest page id is the response and the others are revisits of it, without
    payload. Null html is an empty payload. Rows with the same page id and the
    same payload are responses each. A page without an id is never referred to,
    so it is a response unless another page has its payload. An empty table gives
    an empty archive; columns besides these three are ignored.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    own = own.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = (
        own.where(F.col("payload_bytes") >= MIN_SHARED).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("payload_digest", "first_id")
    )
    # a payload that is too small to share has a key of its own, so short pages don't meet in one task
    key = F.when(F.col("payload_bytes") >= MIN_SHARED, F.col("payload_digest")).otherwise(F.concat(F.lit("page "), F.xxhash64("page_id", "url", "payload").cast("string")))
    typed = own.withColumn("k", key).join(shared.withColumnRenamed("payload_digest", "k"), "k", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    typed = typed.select(F.monotonically_increasing_id().alias("record_id"), "page_id", "url", "payload", "payload_digest", "payload_bytes", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                rid, pid, u, body, digest, length, ref = (c[i].as_py() for c in columns)
                for row in _chunks(rid, pid, u, body, digest, length, ref, chunk_bytes):
                    rows.append(row)
                    held += len(row[4])
                    if held >= _FLUSH:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return staged(typed.mapInArrow(write, CHUNKS), "archive")


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, stored_bytes long, stored_digest string, chunks int"


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    return dict(x.split(": ", 1) for x in lines[1:] if x)


def read_archive(archive: DataFrame) -> DataFrame:
    """One row a record, read back chunk by chunk; a wrong digest, a gap or a missing end is an error.

    A record of one chunk is read where it lies; only the chunks of longer
    records are brought together, so short payloads aren't moved again.
    """
    alone = (F.col("chunk_no") == 0) & F.col("chunk_end")
    longer = archive.where(~alone).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")

    def urn(x: str | None) -> int | None:
        return None if x is None or x == "<urn:page:>" else int(x.removeprefix("<urn:page:").removesuffix(">"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out, now, expect = [x.split()[0] for x in RECORDS.split(", ")], [], None, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                rid, no, last, head, data, digest = (c[i].as_py() for c in columns)
                if no == 0:
                    now, expect, fields, running, size = rid, 0, parse_header(data[:head]), hashlib.sha256(), 0
                if rid != now or no != expect:
                    raise ValueError(f"record {rid}: chunk {no} where {expect} of {now} was due")
                piece = memoryview(data)[head : len(data) - (4 if last else 0)]
                running.update(piece)
                size, expect = size + len(piece), expect + 1
                if running.hexdigest() != digest:
                    raise ValueError(f"record {rid}: chunk {no} has another digest")
                if last:
                    claimed = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if size != int(fields["Content-Length"]) or (fields["WARC-Type"] == "response" and digest != claimed):
                        raise ValueError(f"record {rid}: payload differs from its header")
                    out.append((urn(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], urn(fields.get("WARC-Refers-To")), int(fields["X-Payload-Length"]), claimed, size, digest, expect))
                    now = None
            if len(out) >= 4096:
                yield _record_batch(out, names)
                out = []
        if now is not None:
            raise ValueError(f"record {now} has no end")
        if out:
            yield _record_batch(out, names)

    return archive.where(alone).mapInArrow(read, RECORDS).unionByName(longer.mapInArrow(read, RECORDS))


def _record_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op10_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archive(write_archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc_chunks": op10_warc_chunks}
SQL = {
    "op10_warc_chunks": f"""WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {MIN_SHARED} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""
}
