"""WARC archives as a chunked record table, written and read as streams.

A record's payload is never one value here: it is rows of a record identifier
and a chunk number, in both directions, with digests carried from chunk to
chunk.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm.common import table
from verdance.storage import fresh_path, materialize

CHUNK_BYTES = 64 * 1024
#: Bytes of archives after which a task opens the next file.
ROLL_BYTES = 512 * 1024 * 1024
#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
ID_PREFIX = "urn:verdance:record:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, id_col: str, payload: Column) -> DataFrame:
    """``(id, sha256, first_id)``: for each row the smallest id with an equal payload.

    Only ids and digests are shuffled; the smallest id of a digest comes from a
    map-side minimum, so a payload that a third of all rows share is no hot
    key there, and a join that meets it can be split.
    """
    keys = pages.select(F.col(f"`{id_col}`").alias("id"), F.sha2(payload, 256).alias("sha256"))
    first = keys.groupBy("sha256").agg(F.min("id").alias("first_id"))
    return keys.distinct().join(first, "sha256")


def chunk_rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: ``id, url, size, sha1, refers_to, revisit, chunk_no, chunk``, a record's chunks in order in one partition.

    ``payload_col`` is text, written as UTF-8, or binary; null is an empty
    payload, which has one empty chunk, and so has a revisit.  Rows that repeat
    an id and a payload are records of their own and of the same type; a null
    id is an id, and the largest.  Other columns are not read.  An empty table
    has no chunks.

    Payloads are cut where they are read; from there on no row is larger than
    a chunk.
    """
    id_, payload = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    types = record_types(pages, id_col, payload)
    whole = pages.select(F.monotonically_increasing_id().alias("record"), id_.alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    steps = F.sequence(F.lit(0), ((F.greatest(size, F.lit(1)) - 1) / chunk_bytes).cast("int"))
    # The pieces are one array, so that no exploded row drags the payload along; the outer lambda makes the bytes of the text once, not once a piece.
    pieces = F.transform(F.array("payload"), lambda p: F.transform(steps, lambda i: F.substring(p, i * chunk_bytes + 1, F.lit(chunk_bytes))))[0]
    # Digests come before the explosion: after it they would be taken once a piece.
    rows = whole.select("record", "id", "url", size.alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), pieces.alias("pieces"))
    rows = rows.select("record", "id", "url", "size", "sha1", "sha256", F.posexplode_outer("pieces").alias("chunk_no", "chunk"))
    rows = rows.join(types.withColumnsRenamed({"id": "id_", "sha256": "sha_"}).hint("merge"), F.col("id").eqNullSafe(F.col("id_")) & (F.col("sha256") == F.col("sha_")))
    revisit = ~F.col("id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("revisit", revisit).where("not revisit or chunk_no = 0").sortWithinPartitions("id", "sha256", "record", "chunk_no")
    chunk = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("chunk"))
    return rows.select("id", "url", "size", "sha1", F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"), "revisit", "chunk_no", chunk.alias("chunk"))


class _GzipMembers:
    """Writes each record as a gzip member of its own to a stream that takes bytes."""

    def __init__(self, out):
        self.out, self.z, self.n = out, None, 0

    def put(self, data: bytes) -> None:
        if self.z is None:
            self.z = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._raw(self.z.compress(data))

    def end(self) -> None:
        self._raw(self.z.flush())
        self.z = None

    def _raw(self, data: bytes) -> None:
        self.out.write(data)
        self.n += len(data)


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _head(record_id, url, size, sha1, refers_to, revisit) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID_PREFIX}{'null' if record_id is None else record_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    lines.append(f"WARC-Payload-Digest: sha1:{_base32(sha1)}")
    if revisit:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_warc(chunks: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the chunked record table as ``.warc.gz`` files below ``folder``; return the manifest ``(path, records, bytes)``.

    ``folder`` is a URI that executors can write to.  Every attempt of a task
    writes files of its own name and only the finished attempt's names come
    back, so a lost executor leaves a stray file that no manifest names, never
    half a file that one does.  A task holds one chunk and a compressor.
    """
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        done, out, gz, records, path = [], None, None, 0, ""
        for b in batches:
            for record_id, url, size, sha1, refers_to, revisit, chunk_no, chunk in zip(*b.columns):
                if not chunk_no.as_py():
                    if gz and gz.z:
                        gz.put(b"\r\n\r\n")
                        gz.end()
                    if gz is None or gz.n >= roll_bytes:
                        if gz:
                            out.close()
                            done.append((path, records, gz.n))
                        fs.create_dir(base, recursive=True)
                        path, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(path, compression=None)
                        gz = _GzipMembers(out)
                    gz.put(_head(record_id.as_py(), url.as_py(), size.as_py(), sha1.as_py(), refers_to.as_py(), revisit.as_py()))
                    records += 1
                gz.put(memoryview(chunk.as_buffer()))
        if gz:
            gz.put(b"\r\n\r\n")
            gz.end()
            out.close()
            done.append((path, records, gz.n))
        for row in done:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return materialize(chunks.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class _Unzipped:
    """Bytes of a file of gzip members, read and unpacked piece by piece."""

    def __init__(self, f, step: int):
        self.f, self.step, self.z, self.held, self.over = f, step, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        while not self.over:
            packed = self.z.unconsumed_tail or (self.z.unused_data if self.z.eof else b"") or self.f.read(self.step)
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            if not packed:
                self.over = True
                return False
            got = self.z.decompress(packed, self.step)
            if got:
                self.held += got
                return True
        return False

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while not self.held and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def headers(self) -> dict[str, str] | None:
        while (first := self.line()) == b"":
            pass
        if first is None:
            return None
        out = {"": first.decode()}
        while line := self.line():
            k, _, v = line.decode().partition(":")
            out[k.strip().lower()] = v.strip()
        return out


def records_of(f, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """``(id, url, record_type, refers_to, declared_digest, chunk_no, chunk, bytes_so_far, digest_so_far, last)`` of an open archive.

    The digest is carried from chunk to chunk; on a record's last row it is
    the payload's.  A revisit has no payload here: its one row carries the
    digest and length that the archive states for the payload it repeats.
    """
    data = _Unzipped(f, chunk_bytes)
    named = lambda v: None if v is None or v == f"<{ID_PREFIX}null>" else int(v[len(ID_PREFIX) + 1 : -1])
    while (head := data.headers()) is not None:
        kind, left = head["warc-type"], int(head["content-length"])
        meta = (named(head.get("warc-record-id")), head.get("warc-target-uri"), kind, named(head.get("warc-refers-to")), head.get("warc-payload-digest", "").removeprefix("sha1:"))
        http_size = 0
        stated = 0
        if head.get("content-type", "").startswith("application/http"):
            lines = [data.line() or b""]
            while lines[-1]:
                lines.append(data.line() or b"")
            http_size = sum(len(x) + 2 for x in lines)
            stated = next((int(x.split(b":")[1]) for x in lines if x.lower().startswith(b"content-length:")), 0)
        left -= http_size
        if kind == "revisit":
            yield *meta, 0, b"", stated, meta[4], True
            continue
        digest, seen, no = hashlib.sha1(), 0, 0
        while True:
            parts, want = [], min(left, chunk_bytes)
            while want and (part := data.take(want)):
                parts.append(part)
                want -= len(part)
            if want:
                raise EOFError(f"record {meta[0]}: the archive ends inside its payload")
            chunk = b"".join(parts)
            digest.update(chunk)
            seen, left = seen + len(chunk), left - len(chunk)
            yield *meta, no, chunk, seen, base64.b32encode(digest.digest()).decode(), not left
            no += 1
            if not left:
                break


def read_warc(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_chunks: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``manifest`` names, as ``records_of`` gives it.

    One row per chunk; ``chunk`` is null unless ``with_chunks``.  A response
    whose payload does not have its declared digest fails the read.
    """
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        held, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    for row in records_of(f, chunk_bytes):
                        if row[9] and row[8] != row[4]:
                            raise ValueError(f"record {row[0]} in {path}: digest {row[8]}, declared {row[4]}")
                        held.append(row if with_chunks else (*row[:6], None, *row[7:]))
                        size += len(row[6]) * with_chunks
                        if len(held) >= 2048 or size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    # A partition for each file: the manifest's few rows would otherwise be one task.
    files = manifest.select("path").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "id long, url string, record_type string, refers_to long, declared_digest string, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC records and read back."""
    folder = fresh_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    chunks = chunk_rows(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    back = read_warc(write_warc(chunks, folder), folder, with_chunks=False).where("last")
    return back.select(F.col("id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


#: Base 32 of a SHA-1 has 32 digits of 5 bits; DuckDB has no function for it.
OP1_SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
    f AS (SELECT hex, n, min(page_id) AS first_id FROM d GROUP BY hex, n),
    digits AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v, 1), '' ORDER BY i) AS digest FROM (
        SELECT hex, i, CAST((CAST('0x' || substr(hex, 1 + (i // 8) * 10, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) AS v FROM (SELECT DISTINCT hex FROM d), range(32) AS r(i)
    ) GROUP BY hex)
    SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, digits.digest AS payload_digest,
        CASE WHEN d.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN d.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
    FROM d JOIN f ON d.hex = f.hex AND d.n = f.n JOIN digits ON d.hex = digits.hex"""
