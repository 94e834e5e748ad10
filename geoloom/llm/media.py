"""Media columns stored as content-defined chunks.

A payload is cut where a rolling gear hash of its last bytes has `mask_bits` zero bits, so equal
stretches are cut alike wherever they lie. Chunk digests meet in a Spark aggregation that tells
which occur more than once; a bitmap of fixed size of those goes to the tasks. The store is two tables:

* `lists`: for each payload its length, its SHA-256, its recipe (an entry of digest, size and a mark for
  shared chunks, in order) and, in one piece, the bytes of the chunks that nobody shares;
* `chunks`: digest and bytes of the shared chunks, one row for each (deduplicated by a join key, the digest).

Reading back fetches shared chunks by left joins on digests; payloads without any are put together
where they lie. Every chunk's digest, and each payload's length and SHA-256, are checked: a chunk that is
missing or altered, or a list out of order, is an error and never a missing row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, digest_keys, in_slices, scratch_path, sent_bitmap, ship

ship(__name__)

UNIT = 64
GEAR = np.random.default_rng(20240607).integers(0, 2**32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> bytes:
    """UTF-8, with zeros up to a positive multiple of 64 bytes."""
    data = (text or "").encode()
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def cuts(data: bytes, mask_bits: int = 10, least: int = 512, most: int = 8192) -> list[int]:
    """Ends of the chunks. The gear hash of the last 32 bytes is built by doubling: h2[i] = h[i] + (h[i-1] << 1), and so on."""
    raw = np.frombuffer(data, np.uint8)
    ends, at, step = [], 0, 1 << 22
    places = []
    for begin in range(0, len(raw), step):
        lead = min(begin, 31)
        h = GEAR[raw[begin - lead : begin + step]]
        for s in (1, 2, 4, 8, 16):
            more = h.copy()
            more[s:] += h[:-s] << np.uint32(s)
            h = more
        places.append(np.flatnonzero((h[lead:] >> np.uint32(32 - mask_bits)) == 0) + begin + 1)
    for p in np.concatenate(places).tolist() if places else []:
        while p - at > most:
            at += most
            ends.append(at)
        if p - at >= least:
            at = p
            ends.append(at)
    while len(data) - at > most:
        at += most
        ends.append(at)
    if at < len(data):
        ends.append(len(data))
    return ends


def chunk_digests(mask_bits: int):
    """(digest, how often) of a task's chunks."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_pydict({"digest": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

        for b in batches:
            for text in b.column(0).to_pylist():
                data, at = payload_of(text), 0
                for end in cuts(data, mask_bits):
                    counts[hashlib.sha256(data[at:end]).digest()] += 1
                    at = end
                if len(counts) > 100_000:
                    yield flush()
                    counts.clear()
        yield flush()

    return run


ENTRY, ENTRY_BYTES = "<32sIB", 37
STORED = pa.schema([("row", pa.int64()), ("id", pa.null()), ("n_bytes", pa.int64()), ("sha256", pa.binary()), ("recipe", pa.binary()), ("own", pa.binary()), ("far", pa.list_(pa.binary())), ("digest", pa.binary()), ("bytes", pa.binary())])


def store_rows(mask_bits: int, sent, hold: int = 4 << 20):
    """List rows, and rows of chunks that may be shared (digest and bytes; once from a task of up to 200,000)."""

    def run(batches):
        kept: dict[bytes, bytes] = {}
        told: set[bytes] = set()
        size = 0
        shared: Bitmap = sent.value

        def table(lists: list[tuple], ids: pa.Array, chunks: dict[bytes, bytes]):
            n, m = len(lists), len(chunks)
            columns = [pa.concat_arrays([ids, pa.nulls(m, ids.type)])] if n else [pa.nulls(m, ids.type)]
            rest = [pa.array([*(x[k] for x in lists), *[None] * m], STORED.field(c).type) for k, c in enumerate(("row", "n_bytes", "sha256", "recipe", "own", "far"))]
            tail = [pa.array([*[None] * n, *c], pa.binary()) for c in (chunks.keys(), chunks.values())]
            return pa.RecordBatch.from_arrays([rest[0], *columns, *rest[1:], *tail], STORED.names)

        ids = None
        for b in batches:
            ids = b.column(1)
            for x in range(0, b.num_rows, 500):
                part = b.slice(x, 500)
                lists = []
                for row, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                    data = payload_of(text)
                    ends = cuts(data, mask_bits)
                    pieces = [data[a:z] for a, z in zip([0, *ends], ends)]
                    digests = [hashlib.sha256(c).digest() for c in pieces]
                    far = shared.has(digest_keys(digests)).tolist()
                    for d, c, away in zip(digests, pieces, far):
                        if away and d not in told:
                            told.add(d)
                            kept[d] = c
                            size += len(c)
                    recipe = b"".join(struct.pack(ENTRY, d, len(c), away) for d, c, away in zip(digests, pieces, far))
                    own = b"".join(c for c, away in zip(pieces, far) if not away)
                    lists.append((row, len((text or "").encode()), hashlib.sha256(data).digest(), recipe, own, list({d for d, away in zip(digests, far) if away})))
                if len(told) > 200_000:  # then a chunk may be told again
                    told.clear()
                if size > hold:
                    yield table(lists, part.column(1), kept)
                    kept, size = {}, 0
                else:
                    yield table(lists, part.column(1), {})
        if kept:
            yield table([], ids, kept)

    return run


class ChunkStore:
    def __init__(self, spark: SparkSession, folder: str, mask_bits: int = 10, bitmap_bits: int = 1 << 26):
        self.spark, self.folder, self.mask_bits, self.bitmap_bits = spark, folder, mask_bits, bitmap_bits

    def write(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Stores every row's payload (a null text's is empty); repeated rows share their chunks; an empty table leaves an empty store. Other columns are left out, so their names can't clash."""
        bits, kind = self.mask_bits, docs.schema[id_col].dataType.simpleString()
        text = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        each = text.select("text").mapInArrow(chunk_digests(bits), "digest binary, n long")
        often = each.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")

        def keys(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"key": pa.array(digest_keys(b.column(0).to_pylist()).view(np.int64))})

        sent = sent_bitmap(often.mapInArrow(keys, "key long"), self.bitmap_bits)
        shape = f"row long, id {kind}, n_bytes long, sha256 binary, recipe binary, own binary, far array<binary>, digest binary, bytes binary"
        text.mapInArrow(store_rows(bits, sent), shape).withColumn("part", F.when(F.col("digest").isNull(), "lists").otherwise("pieces")).write.partitionBy("part").option("compression", "zstd").parquet(f"{self.folder}/store")
        self.shape = shape
        pieces = self._part("pieces").groupBy("digest").agg(F.first("bytes").alias("bytes"))
        pieces.write.option("compression", "zstd").parquet(f"{self.folder}/chunks")

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self.shape}, part string").parquet(f"{self.folder}/store").where(F.col("part") == name)

    def lists(self) -> DataFrame:
        return self._part("lists").select("row", "id", "n_bytes", "sha256", "recipe", "own", "far")

    def chunks(self) -> DataFrame:
        return self.spark.read.schema("digest binary, bytes binary").parquet(f"{self.folder}/chunks")

    def read(self) -> DataFrame:
        """(id, n_bytes, recipe, payload): payloads put together from the stored bytes; whatever differs from what was stored is an error."""
        lists = self.lists()
        whole = lists.where(F.size("far") == 0).withColumn("more", F.lit(None).cast("array<struct<digest:binary,bytes:binary>>"))
        part = lists.where(F.size("far") > 0)
        wanted = part.select("row", F.explode("far").alias("digest"))
        fetched = wanted.join(self.chunks(), "digest", "left").groupBy("row").agg(F.collect_list(F.struct("digest", "bytes")).alias("more"))
        rows = whole.unionByName(part.join(fetched, "row", "left"))
        payload = assemble()(F.col("n_bytes"), F.col("sha256"), F.col("recipe"), F.col("own"), F.col("more"))
        return rows.select("id", "n_bytes", "recipe", payload.alias("payload"))


def put_together(n_bytes: int, sha256: bytes, recipe: bytes, own: bytes, more: dict[bytes, bytes | None]) -> bytes:
    out, at = [], 0
    for digest, size, away in struct.iter_unpack(ENTRY, recipe):
        data = more.get(digest) if away else own[at : at + size]
        if data is None:
            raise ValueError(f"chunk {digest.hex()} is missing")
        if len(data) != size or hashlib.sha256(data).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} differs from its digest or size")
        at += 0 if away else size
        out.append(data)
    payload = b"".join(out)
    if len(payload) != max(UNIT, -(-n_bytes // UNIT) * UNIT) or hashlib.sha256(payload).digest() != sha256:
        raise ValueError("a payload differs from its length or digest")
    return payload


def assemble():
    def some(*columns: pa.Array) -> pa.Array:
        return pa.array([put_together(n, s, r, o, {c["digest"]: c["bytes"] for c in m or ()}) for n, s, r, o, m in zip(*(c.to_pylist() for c in columns))], pa.binary())

    def run(n_bytes: pa.Array, sha256: pa.Array, recipe: pa.Array, own: pa.Array, more: pa.Array) -> pa.Array:
        return in_slices(some, n_bytes, sha256, recipe, own, more)

    return F.arrow_udf(run, "binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe():
    """Figures of payloads read back. The media form of one payload is as it is stored: for each chunk its digest and 32-bit size, taken from the recipe, and then the chunks' bytes.

    Whether a chunk is shared depends on other rows, so that mark is no part of the form: equal texts have equal values."""

    def some(recipes: pa.Array, payloads: pa.Array) -> pa.Array:
        rows = []
        for recipe, data in zip(recipes.to_pylist(), payloads.to_pylist()):
            head = b"".join(recipe[k : k + ENTRY_BYTES - 1] for k in range(0, len(recipe), ENTRY_BYTES))
            media = hashlib.sha256(head)
            media.update(data)
            raw = np.frombuffer(data, np.uint8)
            rows.append(
                {
                    "payload_bytes": len(data),
                    "payload_sha256": hashlib.sha256(data).hexdigest(),
                    "tail_crc32": zlib.crc32(data[-UNIT:]),
                    "media_bytes": len(head) + len(data),
                    "media_sha256": media.hexdigest(),
                    "feature": f"{len(recipe) // ENTRY_BYTES}:{int(raw.sum(dtype=np.int64))}:{int(np.count_nonzero(raw[1:] < raw[:-1]))}",
                }
            )
        return pa.array(rows, pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))

    def run(recipes: pa.Array, payloads: pa.Array) -> pa.Array:
        return in_slices(some, recipes, payloads)

    return F.arrow_udf(run, FEATURES)


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    store = ChunkStore(spark, scratch_path(spark, "media"))
    store.write(docs)
    return store.read().select(F.col("id").alias("doc_id"), "n_bytes", describe()(F.col("recipe"), F.col("payload")).alias("d")).select("doc_id", "n_bytes", "d.*")
