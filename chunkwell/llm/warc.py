"""WARC archives with payload dedup, written and read as a chunked record table.

A payload is never held whole by the archive code: it crosses to the writers as rows of (record, chunk number,
bytes), is compressed chunk by chunk into one gzip member per record, and is read back as rows of the same kind
that carry the SHA-1 of everything up to and including their chunk. Of equal payloads the record with the
smallest page_id is the response, the others are revisit records that name it.

Archives go to the session's shared folder through pyarrow's file systems, under a name of the writing attempt;
only archives that a finished task reports are read, so lost executors and repeated tasks do no harm.

Results for the unusual cases: null html is an empty payload; a null url is an empty target; equal payloads of
any size, empty ones too, are revisits unless ``min_revisit_bytes`` says otherwise; rows that repeat a page_id
with the same payload keep one type, each row its own record; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK_BYTES = 256 * 1024
#: Payload bytes after which a writer starts another archive.
ARCHIVE_BYTES = 128 * 1024 * 1024
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_OF_HEX = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
RECORDS = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, chunk_no long, chunk binary, digest_so_far string, is_last boolean, url string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1; 20 bits of the hex digest are four base-32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), *BASE32_OF_HEX)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Rows of (page_id, url, digest, n, refers_to, payload): payload is null for revisits."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n"), "payload")
    known = common.cut(rows.where(f"n >= {min_revisit_bytes}").select("page_id", "digest"))
    groups = known.groupBy(F.col("digest").alias("group_digest")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = common.cut(groups)
    again = known.join(groups, known["digest"] == groups["group_digest"]).where("not (page_id <=> refers_to)")
    again = common.cut(again.select(F.col("page_id").alias("again_id"), "group_digest", "refers_to").distinct())
    # payloads are dealt by page_id, never by digest: a payload shared by a third of the pages is no hot key
    joined = rows.join(again, rows["page_id"].eqNullSafe(again["again_id"]) & (rows["digest"] == again["group_digest"]), "left")
    return joined.select("page_id", "url", "digest", "n", "refers_to", F.expr("if(group_digest is null, payload, null)").alias("payload"))


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of each record, in order; a record without payload is one row."""
    parts = f"transform(sequence(0, greatest(0, cast((coalesce(octet_length(payload), 0) - 1) div {chunk_bytes} as int))), i -> struct(cast(i as long) as chunk_no, substring(payload, i * {chunk_bytes} + 1, {chunk_bytes}) as chunk))"
    return records.select("page_id", "url", "digest", "n", "refers_to", F.explode(F.expr(parts)).alias("c")).select("page_id", "url", "digest", "n", "refers_to", "c.chunk_no", "c.chunk")


def _name(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _head(page_id, url: str, digest: str, n: int, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
    clean = "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Target-URI: {clean}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class _Archive:
    """One file, under a temporary name until it is closed."""

    def __init__(self, folder: str, stem: str):
        from pyarrow import fs

        self.system, root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(root, recursive=True)
        self.path, self.uri = f"{root}/{stem}.warc.gz", f"{folder}/{stem}.warc.gz"
        self.sink, self.records, self.payload = self.system.open_output_stream(f"{self.path}.open", compression=None), 0, 0

    def close(self) -> tuple[str, int, int]:
        self.sink.close()
        self.system.move(f"{self.path}.open", self.path)
        return self.uri, self.records, self.payload


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, made = TaskContext.get(), 0
        archive = member = None
        left = 0

        def finished(a: _Archive) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in a.close()], ["uri", "records", "payload_bytes"])

        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                page_id, url, digest, n, refers_to, chunk_no = (c[i].as_py() for c in columns[:6])
                chunk = columns[6][i].as_py()
                revisit = chunk is None
                if chunk_no == 0:
                    if archive is not None and archive.payload >= ARCHIVE_BYTES:
                        yield finished(archive)
                        archive = None
                    if archive is None:
                        archive = _Archive(folder, f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{made:04d}")
                        made += 1
                    member, left, seen = zlib.compressobj(1, zlib.DEFLATED, 31), 0 if revisit else n, hashlib.sha1()
                    archive.sink.write(member.compress(_head(page_id, url, digest, n, refers_to, revisit)))
                if not revisit:
                    seen.update(chunk)
                    left -= len(chunk)
                    archive.payload += len(chunk)
                    archive.sink.write(member.compress(chunk))
                if left == 0:
                    if not revisit and b32encode(seen.digest()).decode() != digest:
                        raise ValueError(f"payload of page {page_id} does not have its digest")
                    archive.sink.write(member.compress(b"\r\n\r\n") + member.flush())
                    archive.records += 1
        if archive is not None:
            yield finished(archive)

    return run


def write_archives(records: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the archives; the manifest has uri, records, payload_bytes of each."""
    folder = folder or f"{common.checkpoint_dir(records.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = folder if folder.startswith("file:") else f"file://{folder}"
    return common.cut(chunked(records, chunk_bytes).mapInArrow(_writer(folder), "uri string, records long, payload_bytes long"))


def _fields(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        key, _, value = line.partition(b":")
        out[key.decode().lower()] = value.strip().decode()
    return out


def parse_archive(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of RECORDS from one decompressed archive, holding one chunk at a time."""
    page = lambda name: int(x) if (x := name.strip("<>").rpartition(":")[2]) else None
    while stream.readline():  # the version line
        head = _fields(stream)
        stream.readline()  # the status line
        http = _fields(stream)
        revisit, n = head["warc-type"] == "revisit", int(http["content-length"])
        fixed = (head["warc-record-id"], page(head["warc-record-id"]), head["warc-type"], page(head["warc-refers-to"]) if revisit else None, n)
        if revisit:
            yield *fixed, 0, b"", head["warc-payload-digest"].removeprefix("sha1:"), True, head["warc-target-uri"]
        else:
            seen, left, k = hashlib.sha1(), n, 0
            while True:
                chunk = stream.read(min(chunk_bytes, left))
                if left and not chunk:
                    raise ValueError("archive ends inside a payload")
                seen.update(chunk)
                left -= len(chunk)
                yield *fixed, k, chunk, b32encode(seen.copy().digest()).decode(), left == 0, head["warc-target-uri"]
                k += 1
                if not left:
                    break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")


def _reader(chunk_bytes: int):
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("digest_so_far", pa.string()), ("is_last", pa.bool_()), ("url", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as stream:
                    for row in parse_archive(stream, chunk_bytes):
                        rows.append(row)
                        held += len(row[6]) + 200
                        if held > 4 * CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return run


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives: one row per chunk, see RECORDS."""
    return manifest.select("uri").mapInArrow(_reader(chunk_bytes), RECORDS)


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(plan_records(common.read(spark, sf_dir, "pages")))
    last = read_archives(manifest).where("is_last")
    return last.select("page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


SQL = r"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT page_id, n, h, string_agg(
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) // CAST(pow(32, 3 - k % 4) AS BIGINT)) % 32 AS INTEGER), 1), '' ORDER BY k) AS digest
  FROM (SELECT page_id, n, h, unnest(generate_series(0, 31)) AS k FROM d) x GROUP BY page_id, n, h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
