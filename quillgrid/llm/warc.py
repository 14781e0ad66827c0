"""WARC archives with a Zstandard dictionary in a leading skippable frame.

Layout of an archive (``*.warc.zst``): one skippable frame (magic 0x184D2A5D)
that holds a dictionary trained on the archive's own first records, then one
Zstandard frame per WARC record, compressed with that dictionary.  Any record
can be read alone given the dictionary, and any reader that skips skippable
frames can list the frames.

Of records with equal payloads of ``revisit_from`` bytes or more, that with the
largest page id is the response and the others are revisits that refer to it.
The decision is a partial aggregation on (digest, length); only revisits, as
narrow rows, are joined back to the pages on id, digest and length.  The digests of
most pages are broadcast, and pages are dealt by all three, so neither a payload nor an
id that a third of all pages share is one task's.

Tasks write archives straight to the shared folder through Arrow's filesystems
(file, hdfs, s3, gcs), under a name of the attempt, and rename at the end: a task
that is run again leaves a whole file.  An archive is closed at about
``archive_bytes`` of payload.

Defined cases: null html is an empty payload, a response; empty tables give no
archive; repeated page ids each get their record, and only those rows of an id are
revisits whose own payload a larger id has; null page ids are always responses; null
page ids and urls are written as empty headers and read as null; a payload of any
length is one record, held in memory while it is written; other columns are ignored.
A dictionary is trained on the first 16 KB of each of an archive's first records;
records themselves are written whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SKIPPABLE = 0x184D2A5D
_ID = "urn:x-page:"


def decide(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """(page_id, digest, n, refers_to) of the pages whose record is a revisit: their
    payload, of ``n`` bytes, is that of a page with a larger id."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sums = c.staged(pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("n")).where((F.col("n") >= revisit_from) & F.col("page_id").isNotNull()), "payloads")
    first = sums.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    met = c.join_counted(sums, first, ["digest", "n"], "copies", sums.count())
    return met.where("page_id < refers_to").select("page_id", "digest", "n", "refers_to").distinct()


def record(page_id, url, payload: bytes, refers_to, digest: bytes | None = None) -> bytes:
    """One WARC/1.1 record."""
    digest = digest or hashlib.sha1(payload).digest()
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {'' if url is None else ' '.join(url.split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *more = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in more)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    return fields, rest[:n]


def train_dictionary(samples: list[bytes], size: int = 32 << 10) -> bytes:
    """A Zstandard dictionary; raw content where there is too little to train on."""
    whole = sum(map(len, samples))
    if len(samples) >= 16 and whole >= 8 * size:
        try:
            return zstandard.train_dictionary(size, samples, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


class Writer:
    """Writes one archive: ``add`` records, then ``close``."""

    def __init__(self, out, level: int = 3, sample_bytes: int = 2 << 20):
        self.out, self.level, self.sample_bytes = out, level, sample_bytes
        self.waiting: list[bytes] | None = []
        self.held = self.payload = self.records = self.written = 0

    def add(self, raw: bytes) -> None:
        self.payload += len(raw)
        self.records += 1
        if self.waiting is None:
            self._put(self.squeeze.compress(raw))
            return
        self.waiting.append(raw)
        self.held += len(raw)
        if self.held >= self.sample_bytes:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        own = train_dictionary([x[:16384] for x in self.waiting])
        self._put(struct.pack("<II", SKIPPABLE, len(own)) + own)
        kind = zstandard.DICT_TYPE_FULLDICT if own[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        self.squeeze = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(own, dict_type=kind), write_content_size=True, write_checksum=True)
        first, self.waiting = self.waiting, None
        for raw in first:
            self._put(self.squeeze.compress(raw))

    def close(self) -> None:
        if self.waiting is not None:
            self._begin()
        self.out.close()


def read(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time, in bounded memory."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    own = stream.read(n)
    kind = zstandard.DICT_TYPE_FULLDICT if own[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own, dict_type=kind))
    rest, one, parts = b"", None, []
    while True:
        rest = rest or stream.read(step)
        if not rest:
            if one is not None:
                raise ValueError("cut short")
            return
        one = one or reader.decompressobj()
        parts.append(one.decompress(rest))
        rest = one.unused_data if one.eof else b""
        if one.eof:
            yield b"".join(parts)
            one, parts = None, []


def write(pages: DataFrame, folder: str, revisit_from: int = 1000, archive_bytes: int = 128 << 20) -> DataFrame:
    """Write every page's record under ``folder``; a row for each archive."""
    schema = "path string, records long, bytes long"
    # the few columns of a revisit meet the pages on the page id, and their own payload:
    # a page id may have several, of which only some are revisits
    revisits = decide(pages, revisit_from).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("n").alias("_n"), "refers_to")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    given = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"), F.octet_length(html).alias("n"))
    same = (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")) & (F.col("n") == F.col("_n"))
    dealt = given.join(revisits, same, "left").select("page_id", "url", "html", "refers_to")

    def run(batches):
        where, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        number, made, writer = 0, [], None

        def close():
            writer.close()
            name = f"{base}/part-{task.partitionId():05d}-{number:03d}.warc.zst"
            where.move(held, name)
            made.append((f"{folder}/{name.rpartition('/')[2]}", writer.records, writer.written))

        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page_id, url, html, refers = (x[i].as_py() for x in cols)
                if writer is None:
                    where.create_dir(base, recursive=True)
                    held = f"{base}/_attempt-{task.partitionId()}-{task.taskAttemptId()}-{number}"
                    writer = Writer(where.open_output_stream(held, compression=None))
                writer.add(record(page_id, url, (html or "").encode(), refers))
                if writer.payload >= archive_bytes:
                    close()
                    writer, number = None, number + 1
        if writer is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return dealt.mapInArrow(run, schema)


def read_back(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives whose ``path`` is given."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(field: str | None):
        found = (field or "").removeprefix(f"<{_ID}").removesuffix(">")
        return int(found) if found else None

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                rows = []
                with where.open_input_stream(name, compression=None) as stream:
                    for raw in read(stream):
                        h, body = parse(raw)
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:"))
                        kind = h["WARC-Type"]
                        if kind == "response" and hashlib.sha1(body).digest() != digest:
                            raise ValueError(f"damaged record in {path}")
                        rows.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"] or None, int(h["X-Payload-Length"]), digest.hex(), kind, number(h.get("WARC-Refers-To"))))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return archives.select("path").mapInArrow(run, schema)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write, keep the list of archives in the shared folder, and read back."""
    folder = folder or f"{c.work_dir(spark)}/warc-{uuid.uuid4().hex}"
    made = c.staged(write(pages, folder, **options), "warc-list")
    return read_back(made.repartition(max(1, spark.sparkContext.defaultParallelism), "path"))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    return archive(spark, c.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, payload_bytes, max(page_id) AS top FROM s GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM s JOIN m USING (payload_digest, payload_bytes)
"""
