"""Helpers shared by the corpus operators: scratch tables, batching, word splitting and hashing."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_GAP = re.compile(rb"[\x20\x09-\x0d]")
U64 = np.uint64


def ship(module_name: str) -> None:
    """Functions of the module travel inside the tasks, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it nothing can be written that all would see."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return there.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/geoloom/{name}-{uuid.uuid4().hex}"


def store(folder: str):
    """(file system, path) of a folder for pyarrow, which knows s3a only as s3."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as a Parquet table in the shared folder and reads them back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


class Bitmap:
    """A set of 64-bit keys that may hold a few more than were put in; two bits for each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return keys & U64(bits - 1), (keys >> U64(32)) & U64(bits - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        one, two = self.places(keys, len(self.bits) * 8)
        hit = (self.bits[one >> U64(3)] >> (one & U64(7)).astype(np.uint8)) & 1 > 0
        at = np.flatnonzero(hit)
        two = two[at]
        hit[at] = (self.bits[two >> U64(3)] >> (two & U64(7)).astype(np.uint8)) & 1 > 0
        return hit


def digest_keys(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest as a number."""
    return np.frombuffer(b"".join(d[:8] for d in digests), "<u8")


def sent_bitmap(keys: DataFrame, bits: int = 1 << 26):
    """A broadcast Bitmap of a frame's only column, signed 64-bit numbers: bits / 8 bytes in all, whatever the number of keys. Put together by segments on Spark."""
    assert bits & (bits - 1) == 0 and bits <= 1 << 32
    part = min(bits, 1 << 16)

    def places(batches):
        for b in batches:
            at = np.unique(np.concatenate(Bitmap.places(b.column(0).to_numpy().view(U64), bits))).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"seg": pa.array(at // part, pa.int32()), "bit": pa.array(at % part, pa.int32())})

    def segment(key, group):
        own = np.zeros(part, bool)
        own[group.column("bit").to_numpy()] = True
        return pa.table({"seg": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    rows = keys.mapInArrow(places, "seg int, bit int").distinct().groupBy("seg").applyInArrow(segment, "seg int, bits binary").toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for seg, data in zip(rows.column("seg").to_pylist(), rows.column("bits").to_pylist()):
        out[seg * part // 8 : (seg + 1) * part // 8] = np.frombuffer(data, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(Bitmap(out))


def one_text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str, buckets: int, left: int):
    """True where crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % buckets == left


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def in_slices(run, *columns: pa.Array, rows: int = 500) -> pa.Array:
    """run over slices of the columns, put together: only one slice exists as Python values at a time."""
    return pa.concat_arrays([run(*(c.slice(i, rows) for c in columns)) for i in range(0, len(columns[0]), rows)] or [run(*columns)])


def blocks(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about most at the utmost; a larger item stands alone."""
    begin = total = i = 0
    for i, n in enumerate(sizes, 1):
        if total and total + n > most:
            yield begin, i - 1
            begin, total = i - 1, 0
        total += n
    if i > begin:
        yield begin, i


def byte_table(seed: int, fold: bool = True) -> np.ndarray:
    """A random 64-bit number for each byte; A-Z as a-z if folded."""
    table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    if fold:
        table[65:91] = table[97:123]
    return table


def separator_mask(keep_ascii: bytes | None = None) -> np.ndarray:
    """True for the bytes of words: all but ASCII white space, or only the given ASCII bytes and all above 127."""
    mask = np.ones(256, bool)
    if keep_ascii is None:
        mask[list(WHITE)] = False
    else:
        mask[:128] = False
        mask[list(keep_ascii)] = True
    return mask


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 to n-1 modulo 2**64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 2**64)
        for k, base in enumerate((_BASE, inverse)):
            out = np.empty(size, U64)
            out[0] = 1
            done, step = 1, base
            while done < size:
                more = min(done, size - done)
                out[done : done + more] = out[:more] * U64(step)
                step = step * step % 2**64
                done += more
            _POWERS[k : k + 1] = [out]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of the public splitmix64 generator."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_spans(docs: list[bytes], is_word: np.ndarray, table: np.ndarray | None, chunk: int = 1 << 20):
    """Words of all the texts: (data, starts, ends, hashes or None, first word of each text and one past the last).

    Starts and ends count bytes of data, which holds the texts one after the other. The work
    goes on in chunks cut between words, so that long texts need little beyond their own size."""
    data = b"\n".join(docs) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    starts, ends, hashes = [], [], []
    at, gap = 0, ~is_word
    while at < len(raw):
        end = min(at + chunk, len(raw))
        while end < len(raw):  # cut behind a byte that is no word byte
            found = np.flatnonzero(gap[raw[end - 1 : end + 65535]])
            if len(found):
                end = min(end + int(found[0]), len(raw))
                break
            end = min(end + 65535, len(raw))
        part = raw[at:end]
        word = np.empty(len(part) + 2, np.int8)
        word[0] = word[-1] = 0
        word[1:-1] = is_word[part]
        edge = np.diff(word)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if table is not None and len(s):
            up, down = _powers(len(part))
            sums = np.empty(len(part) + 1, U64)
            sums[0] = 0
            np.cumsum(table[part] * up[: len(part)], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64)))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    none = np.zeros(0, np.int64)
    starts = np.concatenate(starts) if starts else none
    ends = np.concatenate(ends) if ends else none
    begins = np.zeros(len(docs) + 1, np.int64)
    begins[1:] = np.cumsum([len(d) + 1 for d in docs])
    first = np.searchsorted(starts, begins)
    return data, starts, ends, (np.concatenate(hashes) if hashes else np.zeros(0, U64)) if table is not None else None, first


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's words."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[head], np.add.reduceat(counts, head)
