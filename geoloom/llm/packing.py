"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most `size` ids. The histogram of piece lengths
has `size` entries at most and is all that the driver sees; it places lengths longest first into
the shortest open pack, keeping counts of patterns instead of packs.
Pieces learn their place by rank: rows are sorted by length in ranges over all tasks, each task numbers
the pieces of each of its lengths, and a range learns how many lie in the ranges before. So equal lengths
are never gathered in one task, and there is about one row of counts for each range and one for each length.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, written
from .tokens import PretokenIds

ship(__name__)


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many packs, lengths in them): patterns that use up the histogram.

    Lengths go longest first. Of the open patterns the shortest, with the most room, takes the
    length if it fits there; as many packs as both have become a new pattern."""
    open_by_room: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(room: int, n: int, lengths: tuple[int, ...]) -> None:
        if room == 0:
            done.append((n, lengths))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append([n, lengths])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not rooms or rooms[-1] < length:
                each = size // length  # no open pack has room: packs of this length alone
                if left >= each:
                    put(size - each * length, left // each, (length,) * each)
                    left %= each
                if left:
                    put(size - left * length, 1, (length,) * left)
                break
            room = rooms[-1]
            entries = open_by_room[room]
            n, lengths = entries.pop()
            if not entries:
                del open_by_room[room]
                rooms.pop()
            packs = min(n, left)
            put(room - length, packs, (*lengths, length))
            if packs < n:
                put(room, n - packs, lengths)
            left -= packs
    for room in rooms:
        done += [(n, lengths) for n, lengths in open_by_room[room]]
    return done


class Layout:
    """Patterns as arrays: for each length, ranks from `begin` on belong to a slot of a pattern."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]], size: int):
        base, slots = 0, []
        used: dict[int, int] = {}
        for n, lengths in patterns:
            at = 0
            for length in lengths:
                slots.append((length, used.get(length, 0), base, at))
                used[length] = used.get(length, 0) + n
                at += length
            base += n
        self.sequences = base
        slots.sort()
        self.length, self.begin, self.base, self.offset = (np.array(x, np.int64) for x in zip(*slots)) if slots else (np.zeros(0, np.int64),) * 4
        self.shift = int(max(used.values(), default=0)) + 1
        self.key = self.length * self.shift + self.begin

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length * self.shift + rank, "right") - 1
        return self.base[k] + rank - self.begin[k], self.offset[k]


PIECE = "id {}, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long{}"


def cut_pieces(path: str, pattern: str, size: int, end_id: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        ids = PretokenIds(path, pattern)
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                row, start, length, crc, whole, nth, data = [], [], [], [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    raw = ids.ids(text) + end
                    n = len(raw) // 4
                    for s in range(0, n, size):
                        piece = raw[4 * s : 4 * (s + size)]
                        m = len(piece) // 4
                        row.append(k)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(piece))
                        whole.append(n)
                        nth.append(seen[m])
                        seen[m] += 1
                        if with_ids:
                            data.append(np.frombuffer(piece, "<u4").astype(np.int64))
                out = {"id": part.column(0).take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(whole, pa.int64()), "task": pa.array([task] * len(row), pa.int32()), "nth": pa.array(nth, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(data, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def number_by_length(batches):
    """Numbers from 0 the rows of each length in a partition sorted by length, and names the partition."""
    from pyspark import TaskContext

    task, last, seen = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        length = batch.column(batch.schema.get_field_index("length")).to_numpy()
        new = np.concatenate(([length[0] != last], length[1:] != length[:-1]))
        begin = np.where(new, np.arange(n), -seen)  # an open length began `seen` rows before the batch
        rank = np.arange(n) - np.maximum.accumulate(begin)
        last, seen = length[-1], int(rank[-1]) + 1
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        yield pa.RecordBatch.from_pydict(columns | {"task": pa.array(np.full(n, task), pa.int32()), "nth": pa.array(rank, pa.int64())})


def placer(sent):
    def run(length: pa.Array, rank: pa.Array) -> pa.Array:
        seq, at = sent.value.place(length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(at)], ["sequence_id", "offset"])

    return F.arrow_udf(run, "sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    A null or empty text is one piece of the end id alone; repeated rows are packed each. Pieces of a
    sequence lie from offset 0 on without gaps; what is left up to `size` is padding. An empty table has no
    pieces. Other columns are left out, so their names can't clash."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shape = PIECE.format(kind, ", ids array<long>" if with_ids else "")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = written(rows.mapInArrow(cut_pieces(tokenizer_path, pattern, size, end_id, with_ids), shape), "pack-pieces")
    by = ["length", "task", "nth"]  # tells all pieces apart, so a task that is run again gets the same rows
    numbered = written(pieces.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number_by_length, shape), "pack-ranks")
    by_range = numbered.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(by_range.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("before")), "pack-offsets")
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size entries at most
    layout = spark.sparkContext.broadcast(Layout(shortest_pack_first(counts, size), size))
    ranked = numbered.join(offsets.drop("n"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.withColumn("at", placer(layout)(F.col("length"), F.col("rank")))
    more = ["ids"] if with_ids else []
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset", *more)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
