"""WARC archives compressed with a shared Zstandard dictionary.

An archive file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, as in the
public .warc.zst convention; each record is a Zstandard frame of its own behind it. The
dictionary is trained on records of the same file, so a file can be read by itself.

Records of equal payloads: that with the smallest id is a response, the others are revisits that
name it. Digests are counted first. Pages of a payload of their own are archived in the task that reads
them; of the others only what a record needs is shuffled: the payload travels with the response
alone. Two bitmaps of fixed size tell the task which is which; the join on digests that follows
is exact, and its other side is a written table, so that Spark can split a digest of many pages.

Tasks write files under names of their own in the shared folder and report them; the report is a
Parquet table and only files in it count, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, digest_keys, mix, scratch_path, sent_bitmap, ship, store, written

ship(__name__)

MAGIC = 0x184D2A5D
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def one_line(text: str) -> str:
    """Header values hold no control characters."""
    return quote(text, safe="".join(chr(c) for c in range(33, 127)))


def record(page_id, url: str | None, payload: bytes | None, n_bytes: int, digest: bytes, refers_to, revisit: bool, date: str) -> bytes:
    http = HTTP.format(n_bytes).encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode())
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int, sample_bytes: int) -> bytes:
    """Trained on evenly picked records of sample_bytes in sum; where there are too few to train on, the records' own beginning."""
    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    sample = records[::step]
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(x[: size // 8] for x in sample[:8]) or b"\0" * 8


def archive(records: list[bytes], size: int = 1 << 16, sample_bytes: int = 4 << 20, level: int = 6) -> bytes:
    """A whole archive file."""
    data = dictionary(records, size, sample_bytes)
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True, write_content_size=True)
    packed = zstandard.ZstdCompressor(level=19).compress(data)
    return b"".join([struct.pack("<II", MAGIC, len(packed)), packed, *map(press.compress, records)])


def records_of(data: bytes, step: int = 1 << 14):
    """The raw records of an archive, one after the other. Frames are fed in small steps, so that little is read twice."""
    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    words = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    rest, at = memoryview(data), 8 + n
    while at < len(rest):
        part, out = open_.decompressobj(), []
        while not part.eof:
            if at >= len(rest):
                raise ValueError("the last record is cut off")
            out.append(part.decompress(rest[at : at + step]))
            at = min(at + step, len(rest)) - len(part.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """Headers by lower-case name, and the HTTP head and payload."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = block[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    out["payload"] = payload
    return out


REPORT = "path string, records long, bytes long"
DEFERRED = "id long, url string, digest binary, n_bytes long, payload binary"


class Archiver:
    """Collects a task's records into files of about file_bytes; rows() reports those that are done."""

    def __init__(self, folder: str, file_bytes: int):
        self.fs, self.root = store(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.file_bytes, self.held, self.size, self.done = file_bytes, [], 0, []

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= self.file_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data, name = archive(self.held), f"{uuid.uuid4().hex}.warc.zst"
            with self.fs.open_output_stream(f"{self.root}/{name}") as f:
                f.write(data)
            self.done.append((name, len(self.held), len(data)))
            self.held, self.size = [], 0

    def rows(self) -> list[pa.Array]:
        done, self.done = self.done, []
        return [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]


def pair_keys(digests: list[bytes], ids: list) -> np.ndarray:
    """Keys of (digest, id); a null id gives the digest's own."""
    return mix(digest_keys(digests) + np.array([0 if i is None else i % 2**64 for i in ids], U64) * U64(0x9E3779B97F4A7C15))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2026-01-01T00:00:00Z", file_bytes: int = 16 << 20, bitmap_bits: int = 1 << 26) -> DataFrame:
    """Writes a record for each row and returns (path, records, bytes) of the archives.

    A null payload is empty; a null url is left out. Of equal payloads the smallest id is the
    response (null ids count as larger than all); repeated rows of that id are responses each, as are all
    pages of a payload whose ids are all null. An empty table makes no archives and gives no rows. Other columns are left out, so their names can't clash."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    counted = rows.select("id", F.unhex(F.sha1("payload")).alias("digest")).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = written(counted.where("n > 1").select("digest", "first"), "warc-shared")

    def keys(with_id: bool):
        def run(batches):
            for b in batches:
                d = b.column(0).to_pylist()
                k = pair_keys(d, b.column(1).to_pylist()) if with_id else digest_keys(d)
                yield pa.RecordBatch.from_pydict({"key": pa.array(k.view(np.int64))})

        return shared.mapInArrow(run, "key long")

    many, first = sent_bitmap(keys(False), bitmap_bits), sent_bitmap(keys(True), bitmap_bits)

    def in_place(batches):
        out = Archiver(folder, file_bytes)

        def batch(later: list[tuple]) -> pa.RecordBatch:
            done = out.rows()
            none = [pa.nulls(len(done[0]), f.type) for f in LATER]
            rest = [pa.array([x[k] for x in later], f.type) for k, f in enumerate(LATER)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([a, pa.nulls(len(later), a.type)]) for a in done] + [pa.concat_arrays([a, b]) for a, b in zip(none, rest)], ["path", "records", "bytes", *LATER.names])

        for b in batches:
            for x in range(0, b.num_rows, 500):
                ids, urls, payloads = (c.to_pylist() for c in b.slice(x, 500).columns)
                digests = [hashlib.sha1(p).digest() for p in payloads]
                again = many.value.has(digest_keys(digests))
                lowest = first.value.has(pair_keys(digests, ids))
                later = []
                for i, url, data, digest, wait, whole in zip(ids, urls, payloads, digests, again, lowest):
                    if wait:
                        later.append((i, url, digest, len(data), data if whole or i is None else None))
                    else:
                        out.add(record(i, url, data, len(data), digest, None, False, date))
                yield batch(later)
        out.flush()
        yield batch([])

    def deferred(batches):
        out = Archiver(folder, file_bytes)
        for b in batches:
            for x in range(0, b.num_rows, 500):
                for i, url, digest, n, data, known, lowest in zip(*(c.to_pylist() for c in b.slice(x, 500).columns)):
                    again = bool(known) and lowest is not None and i != lowest
                    out.add(record(i, url, data, n, digest, lowest, again, date))
            yield pa.RecordBatch.from_arrays(out.rows(), ["path", "records", "bytes"])
        out.flush()
        yield pa.RecordBatch.from_arrays(out.rows(), ["path", "records", "bytes"])

    one = written(rows.mapInArrow(in_place, f"{REPORT}, {DEFERRED}"), "warc-first")
    rest = one.where("digest is not null").select(*LATER.names).join(shared.withColumn("known", F.lit(True)), "digest", "left")
    two = rest.select("id", "url", "digest", "n_bytes", "payload", "known", "first").mapInArrow(deferred, REPORT)
    report = f"{folder}/report"
    one.where("path is not null").select("path", "records", "bytes").unionByName(two).write.parquet(report)
    return spark.read.schema(REPORT).parquet(report)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes, url, payload) of the reported archives; a revisit's payload is null."""
    report = spark.read.schema(REPORT).parquet(f"{folder}/report")

    def run(batches):
        fs, root = store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}") as f:
                    data = f.read()
                out = []
                for raw in records_of(data):
                    r = parse(raw)
                    revisit = r["warc-type"] == "revisit"
                    digest = r["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
                        raise ValueError(f"payload of {r['warc-record-id']} differs from its digest")
                    number = lambda k: int(r[k]) if k in r else None  # noqa: B023, E731
                    out.append((number("x-page-id"), r["warc-type"], number("x-refers-to-page"), digest, int(r["http"]["content-length"]) if revisit else len(r["payload"]), r.get("warc-target-uri"), None if revisit else r["payload"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), READ)], [f.name for f in SHAPE])

    files = report.count()
    return report.select("path").repartition(max(1, min(files, 20_000))).mapInArrow(run, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string, payload binary")


LATER = pa.schema([("id", pa.int64()), ("url", pa.string()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("payload", pa.binary())])
SHAPE = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
READ = [f.type for f in SHAPE]


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id,
  CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((strpos('0123456789abcdef', h[(5 * i) // 4 + 1]) - 1) * 16 + greatest(strpos('0123456789abcdef', h[least((5 * i) // 4 + 2, 40)]) - 1, 0)) // (1 << (3 - (5 * i) % 4)) % 32 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
