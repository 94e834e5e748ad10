"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Items of equal words are one. Test items become seeds: (n-gram hash, item, place). Rare n-grams, those of at most `rare`
   items, are all seeds. Of an item's more frequent ones the most frequent `spare` share is none: a passage that has no
   rare seed of an item must have more of its n-grams than that share, and so has one of the others. An n-gram that many items have
   in common doesn't make a pair of each of them with each passage. A bitmap of fixed size of the seeds' hashes goes to
   the tasks, and with it a table of fixed size that tells for a hash how long the longest item around it is.
   Items of `shortest` to n - 1 words are one seed each, and must occur whole.
2. One scan of the corpus finds the places whose n-gram is in the bitmap and keeps the words around
   them (as hashes), as far as those items reach, so the rest of the corpus is never shuffled. Texts
   are read whole.
3. Passages of equal words are one from there on. A pair with a rare seed in common goes on; any other first counts the
   seeds it shares, and goes on if, with the n-grams that are no seeds, they can pass the spare share.
4. Pairs whose common words cannot reach the threshold are left out, which is exact; the others are
   aligned: local alignment of words, match 2, mismatch and gap -1, in blocks of pairs at once. The
   score is divided by that of the whole item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, blocks, byte_table, fresh, mix, sent_bitmap, separator_mask, ship, utf8, word_spans, written
from .toxicity import LETTERS

ship(__name__)

STEP = 0xFF51AFD7ED558CCD


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each n-gram that lies in one text."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        g = g * U64(STEP) + h[k : len(h) - n + 1 + k]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(doc[: len(g)] == doc[n - 1 :])
    return mix(g[inside]), inside


def reach_of(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Words of the longest item that has one of the n-grams, rounded up to a power of two; others of the same place in the table count too."""
    return 1 << bits[g & U64(len(bits) - 1)].astype(np.int64)


def align(texts: np.ndarray, items: np.ndarray, n_items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each row's item (its first n_items words) in its text, and one past the place in the text where it ends.

    Rows are padded: texts with 0, items with 1. A cell's gap in the text is resolved by a running maximum."""
    b, w = texts.shape
    slope = np.arange(w + 1, dtype=np.int32)
    above = np.zeros((b, w + 1), np.int32)
    best, end = np.zeros(b, np.int32), np.zeros(b, np.int64)
    for i in range(items.shape[1]):
        here = np.zeros((b, w + 1), np.int32)
        here[:, 1:] = np.maximum(above[:, :-1] + np.where(texts == items[:, i : i + 1], 2, -1), above[:, 1:] - 1)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        here[i >= n_items] = 0
        top = here.argmax(1)
        score = here[np.arange(b), top]
        more = score > best
        best[more], end[more] = score[more], top[more]
        above = here
    return best, end


def alignments(rows: list[tuple[np.ndarray, np.ndarray]], cells: int = 1_000_000):
    """(score, begin, end) for each (text words, item words), worked out in blocks of like sizes."""
    out = np.zeros((len(rows), 3), np.int64)
    order = np.array(sorted(range(len(rows)), key=lambda k: (len(rows[k][0]), len(rows[k][1]))), np.int64)
    for x, y in blocks([len(rows[k][0]) + 1 for k in order], cells // 8):
        own = order[x:y]
        w, m = max(len(rows[k][0]) for k in own), max(len(rows[k][1]) for k in own)
        texts, items = np.zeros((len(own), w), U64), np.ones((len(own), m), U64)
        back_t, back_i = texts.copy(), items.copy()
        n = np.array([len(rows[k][1]) for k in own])
        for r, k in enumerate(own):
            t, i = rows[k]
            texts[r, : len(t)], items[r, : len(i)] = t, i
        score, end = align(texts, items, n)
        for r, k in enumerate(own):
            t, i = rows[k]
            back_t[r, : end[r]], back_i[r, : len(i)] = t[: end[r]][::-1], i[::-1]
        _, size = align(back_t, back_i, n)
        out[own, 0], out[own, 1], out[own, 2] = score, end - size, end
    return out


class Decontaminator:
    def __init__(self, n: int = 5, threshold: float = 0.5, bitmap_bits: int = 1 << 26, reach_places: int = 1 << 18, rare: int = 30, spare: float = 0.125, shortest: int = 3):
        """threshold: share of the item's full alignment score from which a text counts as contaminated. shortest: items of fewer words say too little to be searched for; 1 searches for all."""
        self.n, self.threshold, self.bitmap_bits, self.reach_places = n, threshold, bitmap_bits, reach_places
        self.rare, self.spare, self.shortest = rare, spare, shortest
        self.table, self.mask = byte_table(41), separator_mask(LETTERS)

    def _items(self, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
        table, mask, n, shortest = self.table, self.mask, self.n, self.shortest

        def run(batches):
            for b in batches:
                *_, h, first = word_spans(utf8(b.column(1)), mask, table)
                g, at = ngrams(h, first, n)
                doc = np.searchsorted(first, at, "right") - 1
                cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
                words = [h[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]
                grams = [g[x:y].view(np.int64) for x, y in zip(cut[:-1], cut[1:])]
                for k, size in enumerate(np.diff(first).tolist()):
                    if shortest <= size < n:
                        grams[k] = ngrams(h[first[k] : first[k + 1]], np.array([0, size]), size)[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], ["item_id", "item_words", "grams"])

        kind = benchmark.schema[id_col].dataType.simpleString()
        rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id {kind}, item_words binary, grams array<long>")
        return written(rows.withColumn("item", F.monotonically_increasing_id()), "leak-items")

    def _seeds(self, items: DataFrame) -> DataFrame:
        """(item, g, ipos, is_rare, many, spared) for items of different words: many is the item's number of different n-grams, spared how many of them are no seeds."""
        every = items.select("item", F.posexplode("grams").alias("ipos", "g"))
        each = every.groupBy("item", "g").agg(F.count("*").alias("times"))
        known = each.join(each.groupBy("g").agg(F.count("*").alias("items")), "g")
        w = Window.partitionBy("item")
        known = known.withColumns({"many": F.count("*").over(w), "nth": F.row_number().over(w.orderBy(F.desc("items"), "g")), "is_rare": F.col("items") <= self.rare})
        known = known.withColumn("keeps", F.col("is_rare") | (F.col("nth") > F.floor(F.col("many") * self.spare)))
        spared = F.sum((~F.col("keeps")).cast("long")).over(w)
        kept = known.withColumn("spared", spared).where("keeps").select("item", "g", "is_rare", "many", "spared")
        return written(every.join(kept, ["item", "g"]), "leak-seeds")

    def _reach(self, items: DataFrame):
        """By place of a table of reach_places bytes: the logarithm of the longest item's number of words."""
        most = self.reach_places

        def run(batches):
            for b in batches:
                g = b.column(0).to_numpy().view(U64)
                yield pa.RecordBatch.from_arrays([pa.array((g & U64(most - 1)).astype(np.int32)), b.column(1)], ["place", "e"])

        e = F.ceil(F.log2(F.greatest(F.octet_length("item_words") / 8, F.lit(1)))).cast("int")
        rows = items.select(F.explode("grams").alias("g"), e.alias("e")).mapInArrow(run, "place int, e int").groupBy("place").agg(F.max("e").alias("e")).toArrow()  # reach_places rows at most
        out = np.zeros(most, np.uint8)
        out[rows.column("place").to_numpy()] = rows.column("e").to_numpy()
        return items.sparkSession.sparkContext.broadcast(out)

    def _passages(self, docs: DataFrame, id_col: str, text_col: str, sent, reach, short: tuple[int, ...] = ()) -> DataFrame:
        """short: the lengths of items of fewer than n words."""
        table, mask, n = self.table, self.mask, self.n

        def run(batches):
            from pyspark import TaskContext

            name = whole = TaskContext.get().partitionId() << 40
            for b in batches:
                texts = utf8(b.column(1))
                rows = []
                for x, y in blocks(map(len, texts), 2_000_000):
                    *_, h, first = word_spans(texts[x:y], mask, table)
                    found = [ngrams(h, first, k) for k in (n, *short)]
                    hit = [np.flatnonzero(sent.value.has(g)) for g, _ in found]
                    g, at = (np.concatenate([f[c][k] for f, k in zip(found, hit)]) for c in (0, 1))
                    if not len(g):
                        continue
                    order = np.argsort(at, kind="stable")
                    g, at = g[order], at[order]
                    margin = reach_of(reach.value, g) * 2 + n  # an item's length beyond its ends, see score_pairs
                    doc = np.searchsorted(first, at, "right") - 1
                    lo, hi = np.maximum(at - margin, first[doc]), np.minimum(at + n + margin, first[doc + 1])
                    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1]))))
                    for s, e in zip(new, np.append(new[1:], len(at))):
                        a, z = lo[s], hi[s:e].max()
                        rows.append((x + doc[s], int(a - first[doc[s]]), h[a:z].tobytes(), g[s:e].view(np.int64), at[s:e] - a))
                name += len(rows)
                whole += b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([whole - b.num_rows + int(r[0]) for r in rows], pa.int64()),
                        pa.array(range(name - len(rows), name), pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.binary()),
                        pa.array([[{"g": g, "at": a} for g, a in zip(r[3].tolist(), r[4].tolist())] for r in rows], pa.list_(pa.struct([("g", pa.int64()), ("at", pa.int64())]))),
                    ],
                    ["id", "row", "passage", "begin", "words", "hits"],
                )

        kind = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return written(rows.mapInArrow(run, f"id {kind}, row long, passage long, begin long, words binary, hits array<struct<g:long,at:long>>"), "leak-passages")

    def find(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
        """(id, item, score, matched, begin, end) of contaminated texts: the best alignment of each row and item; begin and end count words.

        Null and empty texts are never found, nor are items of fewer than `shortest` words. Repeated rows, and rows of
        null or equal ids, each give rows of their own. Other columns are left out, so their names can't clash."""
        every = self._items(benchmark, item_col, item_text_col)
        named = every.groupBy("item_words").agg(F.min("item").alias("item"))
        items = written(every.join(named, ["item_words", "item"], "left_semi"), "leak-item-kinds")
        names = every.join(named.withColumnRenamed("item", "kind"), "item_words").select("kind", "item_id")
        seeds = self._seeds(items)
        bitmap = sent_bitmap(seeds.select("g"), self.bitmap_bits)
        size = F.expr("octet_length(item_words) div 8")
        short = items.where((size < self.n) & (size >= self.shortest)).select(size.cast("int").alias("k")).distinct().collect()  # n rows at most
        passages = self._passages(docs, id_col, text_col, bitmap, self._reach(items), tuple(r.k for r in short))
        keyed = passages.withColumn("key", F.sha2("words", 256))
        first = written(keyed.groupBy("key").agg(F.min("passage").alias("passage")), "leak-kinds")
        kinds = passages.join(first.select("passage"), "passage", "left_semi")
        hits = kinds.select("passage", F.explode("hits").alias("h")).select("passage", "h.g", "h.at")
        diagonal = F.col("at") - F.col("ipos")
        pairs = hits.join(seeds, "g").groupBy("passage", "item").agg(F.min(diagonal).alias("lo"), F.max(diagonal).alias("hi"), F.bool_or("is_rare").alias("is_rare"), F.count_distinct("g").alias("shared"), F.first("many").alias("many"), F.first("spared").alias("spared"))
        pairs = pairs.where(F.col("is_rare") | (F.col("shared") + F.col("spared") > F.floor(F.col("many") * self.spare)))
        rows = pairs.join(passages.select("passage", "words"), "passage").join(items.select("item", "item_words"), "item").withColumnRenamed("item", "kind")
        found = rows.select("passage", "kind", "words", "item_words", "lo", "hi").mapInArrow(score_pairs(self.threshold, self.n), "passage long, kind long, score double, matched long, from long, to long")
        found = written(found.join(first, "passage").drop("passage").join(names, "kind").drop("kind"), "leak-found")
        scored = keyed.select("key", "id", "row", "begin").join(found, "key").select("id", "row", "item_id", "score", "matched", (F.col("begin") + F.col("from")).alias("begin"), (F.col("begin") + F.col("to")).alias("end"))
        best = F.max_by(F.struct("score", "matched", "begin", "end"), F.struct("score", -F.col("begin")))
        return scored.groupBy("row", "item_id").agg(F.first("id").alias("id"), best.alias("b")).select("id", "item_id", "b.*")

    def clean(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
        """The documents without the contaminated ones, told apart by row: ids may be null or repeated."""
        uid = fresh(docs, "row_uid")
        rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "leak-rows")
        # a written table: where it is small, Spark sends it to the documents, which then stay where they are
        bad = written(self.find(rows, benchmark, uid, text_col, **names).select(F.col("id").alias(uid)).distinct(), "leak-rows-found")
        return rows.join(bad, uid, "left_anti").select(*docs.columns)


def score_pairs(threshold: float, n: int):
    """Pairs that reach the threshold; items of fewer than n words must be there whole.

    A gap costs one, and no alignment of at least half the full score has more of them than the item has words: with the
    item's length on both sides, the text around the seeds holds all of it. A lower threshold widens that."""

    def run(batches):
        for b in batches:
            rows, starts, whence, limits = [], [], [], []
            for k, (words, item, lo, hi) in enumerate(zip(*(b.column(c).to_pylist() for c in ("words", "item_words", "lo", "hi")))):
                t, i = np.frombuffer(words, U64), np.frombuffer(item, U64)
                slack = int(np.ceil(2 * len(i) * (1 - min(threshold, 1))))
                least = threshold if len(i) >= n else 1.0
                x, y = max(0, lo - slack), min(len(t), hi + len(i) + slack)
                # a match needs a word of the item that is in the text: no score passes twice their number
                if 2 * np.isin(i, t[x:y]).sum() / max(1, 2 * len(i)) < least:
                    continue
                rows.append((t[x:y], i))
                limits.append(least)
                starts.append(x)
                whence.append(k)
            got = alignments(rows)
            share = got[:, 0] / np.array([max(1, 2 * len(i)) for _, i in rows]) if rows else np.zeros(0)
            keep = np.flatnonzero(share >= np.array(limits))
            at = np.array(starts, np.int64)[keep]
            pick = pa.array(np.array(whence, np.int64)[keep])
            yield pa.RecordBatch.from_arrays([b.column("passage").take(pick), b.column("kind").take(pick), pa.array(share[keep]), pa.array(got[keep, 2] - got[keep, 1]), pa.array(at + got[keep, 1]), pa.array(at + got[keep, 2])], ["passage", "kind", "score", "matched", "from", "to"])

    return run


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return Decontaminator().find(docs, benchmark).withColumnRenamed("id", "doc_id")
