"""WARC archives as a chunked record table.

Writing: payloads become rows (record, chunk number, bytes) of at most
``chunk_bytes``, and a task streams them, record after record, through one
compressor into an archive in shared storage.  Reading is the reverse: a task
walks a segment of an archive and yields chunk rows, each carrying the bytes
and the SHA-1 of the payload so far, so the last chunk of a record holds the
digest of the whole and no step ever needs a whole record in Python.

Payloads that occur more than once are stored once: of equal payloads the
record with the largest id is the response and the others are revisits that
name it.  Equality is decided by a grouped maximum over digests, folded
before the shuffle; the join that hands each row its response is splittable
when one payload fills a third of the table.

Archives are gzip members, one for each record, so a segment can be read from
its byte offset.  File names are unique to each task attempt and only the
manifest, written by Spark, says which files count: a lost or repeated task
leaves at most an unlisted file.

Null payloads are written as empty ones; a null id is read back as null and
its record is always a response; rows that repeat the largest id are all
responses; empty tables give an empty manifest and no records; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.session import scratch_path

CRLF = b"\r\n"
MANIFEST = "file string, start long, length long, records long"
CHUNKS = ("page_id long, record_type string, refers_to long, chunk_no int, chunk binary, "
          "bytes_so_far long, sha1_so_far string, last boolean")
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def with_responses(df: DataFrame, id_col: str, payload_col: str, url_col: str | None, least_bytes: int) -> DataFrame:
    """Rows (page_id, url, payload, n_bytes, sha1, response): ``response`` is
    the id that holds the payload, null for a row that holds its own."""
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    largest = rows.groupBy("sha1").agg(F.max("page_id").alias("holder"))
    own = (F.col("n_bytes") < least_bytes) | F.col("page_id").isNull() | (F.col("page_id") == F.col("holder"))
    return (rows.join(largest, "sha1")
            .withColumn("response", F.when(~own, F.col("holder")))
            .withColumn("payload", F.when(own, F.col("payload")).otherwise(F.lit(b"")))
            .drop("holder"))


def chunked(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row for each chunk of a payload, at least one; a record's chunks
    follow each other in order."""
    last = F.floor(F.greatest(F.octet_length("payload") - 1, F.lit(0)) / chunk_bytes).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last),
                      lambda i: F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.select("page_id", "url", "sha1", "n_bytes", "response", last.alias("last_chunk"),
                       F.posexplode(cut).alias("chunk_no", "chunk"))


def _record_head(page_id, url, sha1: bytes, n_bytes: int, response) -> bytes:
    kind = "response" if response is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}",
             f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{base32_sha1(sha1)}", f"WARC-X-Payload-Length: {n_bytes}",
             f"Content-Length: {n_bytes if response is None else 0}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if response is None:
        lines.append("Content-Type: text/html; charset=utf-8")
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:x-page:{response}>"]
    return CRLF.join(x.encode("utf-8") for x in lines) + CRLF + CRLF


def write_archives(chunks: DataFrame, folder: str, segment_bytes: int, level: int = 1) -> DataFrame:
    """Stream chunk rows into archives below ``folder``; returns the manifest
    (file, start, length, records), written once by Spark."""
    def run(batches):
        from pyarrow import fs
        out = None
        try:
            at = start = records = 0
            for batch in batches:
                cols = [batch.column(n) for n in ("page_id", "url", "sha1", "n_bytes", "response", "last_chunk", "chunk_no")]
                body = batch.column("chunk")
                for i, (page, url, sha1, size, response, last, no) in enumerate(zip(*(c.to_pylist() for c in cols))):
                    if out is None:
                        store, path = fs.FileSystem.from_uri(folder)
                        store.create_dir(path, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    if no == 0:
                        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                        at += out.write(gz.compress(_record_head(page, url, sha1, size, response)))
                    at += out.write(gz.compress(body[i].as_buffer()))
                    if no == last:
                        at += out.write(gz.compress(CRLF + CRLF) + gz.flush())
                        records += 1
                        if at - start >= segment_bytes:
                            yield _manifest(name, start, at, records)
                            start, records = at, 0
            if records:
                yield _manifest(name, start, at, records)
        finally:
            if out is not None:
                out.close()
    return materialize(chunks.mapInArrow(run, MANIFEST), "warc-manifest")


def _manifest(name, start, end, records):
    return pa.RecordBatch.from_pydict({"file": [name], "start": [start], "length": [end - start], "records": [records]},
                                      pa.schema([("file", pa.string()), ("start", pa.int64()),
                                                 ("length", pa.int64()), ("records", pa.int64())]))


class _Inflater:
    """Bytes of a run of gzip members, read ``step`` compressed bytes at a time."""

    def __init__(self, source, start: int, length: int, step: int = 1 << 18):
        self.source, self.left, self.step = source, length, step
        source.seek(start)
        self.gz, self.packed, self.plain = None, b"", b""

    def _more(self) -> bool:
        if not self.packed:
            self.packed = self.source.read(min(self.step, self.left))
            self.left -= len(self.packed)
            if not self.packed:
                return False
        if self.gz is None:
            self.gz = zlib.decompressobj(31)
        self.plain += self.gz.decompress(self.packed, self.step)
        self.packed = self.gz.unconsumed_tail
        if self.gz.eof:
            self.packed, self.gz = self.gz.unused_data, None
        return True

    def line(self) -> bytes | None:
        while (cut := self.plain.find(CRLF)) < 0:
            if not self._more():
                return None
        out, self.plain = self.plain[:cut], self.plain[cut + 2:]
        return out

    def some(self, most: int) -> bytes:
        while not self.plain and self._more():
            pass
        out, self.plain = self.plain[:most], self.plain[most:]
        return out


def _records(source, start: int, length: int, chunk_bytes: int):
    """(page id, type, refers to, chunk number, chunk, bytes so far, SHA-1 so far, last)."""
    data = _Inflater(source, start, length)
    page = lambda uri: int(uri[len("<urn:x-page:"):-1]) if len(uri) > len("<urn:x-page:>") else None
    while (line := data.line()) is not None:
        if line != b"WARC/1.1":
            continue                                   # the blank lines that end a record
        head = {}
        while line := data.line():
            name, _, value = line.partition(b": ")
            head[name.lower()] = value.decode("utf-8")
        kind, left = head[b"warc-type"], int(head[b"content-length"])
        who = page(head[b"warc-record-id"])
        if kind == "revisit":
            yield (who, kind, page(head[b"warc-refers-to"]), 0, b"", int(head[b"warc-x-payload-length"]),
                   head[b"warc-payload-digest"].removeprefix("sha1:"), True)
            continue
        sha, done, no = hashlib.sha1(), 0, 0
        while True:
            parts, got = [], 0
            while left and got < chunk_bytes:
                some = data.some(min(left, chunk_bytes - got))
                if not some:
                    raise ValueError(f"record {who} is cut short")
                sha.update(some)
                parts.append(some)
                got, left = got + len(some), left - len(some)
            done += got
            yield who, kind, None, no, b"".join(parts), done, base32_sha1(sha.copy().digest()), not left
            no += 1
            if not left:
                break
        if base32_sha1(sha.digest()) != head[b"warc-payload-digest"].removeprefix("sha1:"):
            raise ValueError(f"record {who} does not match its digest")


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = 1 << 20, payload: bool = True,
                  segments_per_task: int = 1) -> DataFrame:
    """The chunk table of the archives a manifest lists.  ``payload=False``
    leaves the bytes out (digests and lengths are still of all bytes)."""
    tasks = max(1, manifest.count() // segments_per_task)
    spread = manifest.repartition(tasks)

    def run(batches):
        from pyarrow import fs
        names = ["page_id", "record_type", "refers_to", "chunk_no", "chunk", "bytes_so_far", "sha1_so_far", "last"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for seg in batch.to_pylist():
                held, size = [], 0
                with store.open_input_file(f"{path}/{seg['file']}") as source:
                    for row in _records(source, seg["start"], seg["length"], chunk_bytes):
                        held.append(row if payload else (*row[:4], None, *row[5:]))
                        size += len(row[4]) if payload else 0
                        if len(held) >= 4096 or size >= 8 << 20:
                            yield table(held)
                            held, size = [], 0
                if held:
                    yield table(held)
    return spread.mapInArrow(run, CHUNKS)


def archive_round_trip(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url",
                       folder: str | None = None, least_bytes: int = 0, chunk_bytes: int = 1 << 20,
                       segment_bytes: int = 16 << 20) -> DataFrame:
    """Write the rows as archives below ``folder`` (default: a fresh folder in
    the shared checkpoint folder), read them back, and return one row per
    record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or scratch_path(df.sparkSession, "warc")
    rows = with_responses(df, id_col, payload_col, url_col, least_bytes)
    manifest = write_archives(chunked(rows, chunk_bytes), folder, segment_bytes)
    chunks = read_archives(manifest, folder, chunk_bytes, payload=False)
    # the digest and length so far of a record's last chunk are those of the whole payload
    return (chunks.filter("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"),
                                         F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to"))
