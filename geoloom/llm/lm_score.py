"""Language-model scoring with a log-frequency Bloom filter.

The filter holds pairs of neighbouring classes of the training texts. A count c is kept as a level q
(the number of thresholds up to c), and a pair of level q is put in q times, each time with
another number; probing 1, 2, ... until the first miss gives the level back. Levels are lost
in no case and raised seldom (by false positives).

The model: the `head_words` most frequent words (up to a power of two as least count) and the end of
a text are classes of their own. Rarer words are classes by hash: one for some four of them, `rare_classes`
at most, so pairs of rare words are in the filter too. With C the exact count of a class,
P(b) = (C(b) + 1) / (tokens + classes) and J(a, b) the lower bound of the pair's level less one,

    p(b after a) = (J + (mu + share * C(a)) * P(b)) / ((1 + share) * C(a) + mu + margin)

and a rare word w also has its exact share (c(w) + 1) / (N' + V' + 1) of its class of N' tokens and V'
words. Taking one off each J leaves slack for every successor of a, J never passes C(a) or C(b), and
margin bounds the false positives of all classes together; so the sum over b stays at or below 1.

How it runs on Spark:
* words: per-task counters and one shuffle by word; counts of classes are broadcast (`head_words` + `rare_classes` rows).
* one scan of the texts turns them into class numbers, which are written as a table (`encode`); pairs
  are counted and scored from there, so texts are read and hashed once. Rarer words are joined by word.
* pairs: per-task sorted (pair, count) runs, one shuffle by hash range; each range becomes a
  segment of the filter, sized by its own items.
* segments are laid one behind the other in files of about `max_filter_bytes` in the shared folder. A task opens
  the one file of its pass there, through a memory map where it can; no file is copied to executors. A filter of
  a few files goes over the class numbers once for each and adds the logarithms of its own pairs.
* a filter of more than `most_passes` files would take ever more passes. Then the pairs go to the files instead: the
  levels of the most frequent pairs (`hot_pairs` of them at most: those with over that share of all tokens) are broadcast and answer most places
  at once, the others are shuffled once by file, with a text's repeats as one, and their logarithms come back by text.
  Scores don't depend on the number of files or on the way.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blocks, byte_table, held_out, mix, per_doc, scratch_path, separator_mask, ship, store, sum_by, utf8, word_spans, written

ship(__name__)

SEED = 11
STEP = 0x9E3779B97F4A7C15


def thresholds(growth: float = 1.5, most: int = 2**62) -> np.ndarray:
    """Counts at which the levels 1, 2, ... begin."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out[:-1], np.int64)


def text_blocks(column: pa.Array, most: int = 1_000_000):
    """(first row, texts as UTF-8) for blocks of a column, so that only one block exists twice."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for x, y in blocks(sizes.tolist(), most):
        yield x, utf8(column.slice(x, y - x))


def count_words(batches):
    """Counts of words, flushed when there are many different ones."""
    counts: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    for batch in batches:
        for _, docs in text_blocks(batch.column(0)):
            counts.update({b"\n": len(docs)})  # the end mark; no word holds white space
            for text in docs:
                counts.update(text.lower().split())
            if len(counts) > 150_000:
                yield rows()
                counts.clear()
    yield rows()


def word_keys(words: list[bytes], table: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    return word_spans(words, is_word, table)[3]


class Classes:
    """Class numbers of hashed words: 0 to n - 1 the head words in order of their hashes, then END, START and the rare words' classes by hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_docs: int, n_tokens: int, rare_counts: np.ndarray, rare_types: np.ndarray):
        self.keys, self.n = keys, len(keys)
        self.end, self.start, self.rare = self.n, self.n + 1, self.n + 2
        self.counts = np.concatenate((counts, [n_docs, n_docs], rare_counts)).astype(np.int64)
        self.successors = self.n + 1 + len(rare_counts)  # all but START
        self.unigram = (self.counts + 1) / (n_tokens + self.successors)
        self.rare_bottom = (rare_counts + rare_types + 1).astype(float)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        rare = self.rare + rare_class(hashes, len(self.rare_bottom))
        if not self.n:
            return rare.astype(np.int32)
        at = np.minimum(np.searchsorted(self.keys, hashes), self.n - 1)
        return np.where(self.keys[at] == hashes, at, rare).astype(np.int32)


def rare_class(hashes: np.ndarray, classes: int) -> np.ndarray:
    return (hashes & U64(classes - 1)).astype(np.int64)


def count_rare(table: np.ndarray, is_word: np.ndarray, classes: int):
    """Tokens and words of each rare class, from rows of words and counts."""

    def run(batches):
        n, v = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for batch in batches:
            own = rare_class(word_keys(batch.column(0).to_pylist(), table, is_word), classes)
            np.add.at(n, own, batch.column(1).to_numpy())
            v += np.bincount(own, minlength=classes)
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_pydict({"class": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64()), "v": pa.array(v[at], pa.int64())})

    return run


def rare_words(data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, at: np.ndarray, first: np.ndarray) -> pa.Array:
    """The words at these places as a list of (word, n) for each text."""
    doc = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((hashes[at], doc))
    at, doc = at[order], doc[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashes[at[1:]] != hashes[at[:-1]])))) if len(at) else at
    n = np.diff(np.append(new, len(at)))
    words = [data[x:y].lower() for x, y in zip(starts[at[new]].tolist(), ends[at[new]].tolist())]
    each = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[new], np.arange(len(first))), pa.int32()), each)


ENCODED = "uid long, id {}, train boolean, n_tokens long, head_known long, head_sum double, shift double, ids binary, tail array<struct<word:binary,n:long>>"


def encoder(sent, table: np.ndarray, is_word: np.ndarray, bottom: float):
    def run(batches):
        classes = sent.value
        logs = np.log10((classes.counts[: classes.end + 1] + 1) / bottom)
        shifts = np.log10(bottom / classes.rare_bottom)  # from the whole base to that of a rare class
        for batch in batches:
            for x, docs in text_blocks(batch.column(3)):
                data, starts, ends, hashes, first = word_spans(docs, is_word, table)
                kinds, which = np.unique(hashes, return_inverse=True)
                own = classes.of(kinds)[which]
                in_head = own < classes.n
                rare = np.flatnonzero(~in_head)
                n_rare = per_doc((~in_head).astype(np.int64), first)
                shift = per_doc(np.where(in_head, 0.0, shifts[np.maximum(own - classes.rare, 0)]), first)
                sums = per_doc(np.where(in_head, logs[np.minimum(own, classes.end)], 0.0), first) + logs[classes.end]
                size = first[1:] - first[:-1]
                cut = first.tolist()
                part = batch.slice(x, len(docs))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array(size + 1, pa.int64()),
                        pa.array(size - n_rare + (classes.counts[classes.end] > 0), pa.int64()),
                        pa.array(sums),
                        pa.array(shift),
                        pa.array([own[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                        rare_words(data, starts, ends, hashes, rare, first),
                    ],
                    ["uid", "id", "train", "n_tokens", "head_known", "head_sum", "shift", "ids", "tail"],
                )

    return run


def neighbours(column: pa.Array, classes_start: int, classes_end: int, most: int = 1_000_000):
    """(first row, pairs of neighbouring classes as a * 2**32 + b, where each text's pairs begin) for blocks of encoded texts."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for x, y in blocks((sizes + 8).tolist(), most):
        rows = column.slice(x, y - x).to_pylist()
        ids = np.frombuffer(b"".join(rows), np.int32).astype(np.int64)
        n = sizes[x:y] // 4
        at = np.concatenate(([0], np.cumsum(n + 1)))  # a text of n words has n + 1 pairs
        after = np.empty(at[-1], np.int64)
        after[at[1:] - 1] = classes_end
        inner = np.ones(at[-1], bool)
        inner[at[1:] - 1] = False
        after[inner] = ids
        before = np.concatenate(([0], after[:-1]))
        before[at[:-1]] = classes_start
        yield x, (before << 32 | after).view(U64), at


def segment_of(pairs: np.ndarray, segments: int) -> np.ndarray:
    return ((mix(pairs * U64(STEP) + U64(1)) >> U64(32)) * U64(segments) >> U64(32)).astype(np.int64)


def runs_by_segment(pairs: np.ndarray, segments: int):
    """One row for each segment: the sorted pairs and their counts as bytes."""
    keys, counts = np.unique(pairs, return_counts=True)
    seg = segment_of(keys, segments)
    order = np.argsort(seg, kind="stable")
    seg, keys, counts = seg[order], keys[order], counts[order]
    cut = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))) if len(seg) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(seg))
    small = counts.max(initial=0) < 256
    return pa.RecordBatch.from_pydict(
        {
            "seg": pa.array(seg[cut], pa.int32()),
            "pairs": pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            "counts": pa.array([counts[a:b].astype("<u1" if small else "<i8").tobytes() for a, b in zip(cut, ends)], pa.binary()),
        }
    )


def count_pairs(segments: int, start: int, end: int, hold: int = 1_500_000):
    def run(batches):
        kept, held = [], 0
        for batch in batches:
            for _, pairs, _ in neighbours(batch.column(0), start, end):
                kept.append(pairs)
                held += len(pairs)
                if held >= hold:
                    yield runs_by_segment(np.concatenate(kept), segments)
                    kept, held = [], 0
        if held:
            yield runs_by_segment(np.concatenate(kept), segments)

    return run


def places(pairs: np.ndarray, level: int, probe: int, base, size) -> np.ndarray:
    """Bit positions of items at a level: double hashing inside their segments."""
    a = mix(pairs + U64(level * STEP % 2**64))
    b = (a >> U64(32)) | U64(1)
    return base + (((a + U64(probe) * b) & U64(0xFFFFFFFF)) * size >> U64(32))


def fill_segment(levels: np.ndarray, probes: np.ndarray, bits_per_probe: float, segments: int, hot_from: int):
    """Merges a segment's runs and sets its bits; pairs of counts from hot_from on come with their levels too."""

    def run(key, group):
        keys, counts = [], []
        for h, c in zip(group.column("pairs").to_pylist(), group.column("counts").to_pylist()):
            k = np.frombuffer(h, U64)
            keys.append(k)
            counts.append(np.frombuffer(c, "<u1" if len(c) == len(k) else "<i8").astype(np.int64))
        k, c = sum_by(np.concatenate(keys), np.concatenate(counts))
        q = np.searchsorted(levels, c, "right")
        set_ = int((np.bincount(q, minlength=len(levels) + 1)[::-1].cumsum()[::-1][1:] * probes).sum())
        size = max(64, -(-int(set_ * bits_per_probe) // 64) * 64)
        bits = np.zeros(size, bool)
        for level in range(1, int(q.max(initial=0)) + 1):
            own = k[q >= level]
            for j in range(probes[level - 1]):
                bits[places(own, level, j, U64(0), U64(size))] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        seg = key[0].as_py()
        hot = k[c >= hot_from]
        hot_levels = Filter(segments, [(seg, 0, size // 8)], probes, np.frombuffer(packed, np.uint8)).level(hot).astype(np.uint8)
        row = {"seg": seg, "bits": packed, "n_bytes": size // 8, "n_set": int(bits.sum()), "hot": hot.tobytes(), "hot_levels": hot_levels.tobytes()}
        return pa.Table.from_pylist([row], SEGMENT)

    return run


SEGMENT = pa.schema([("seg", pa.int32()), ("bits", pa.binary()), ("n_bytes", pa.int64()), ("n_set", pa.int64()), ("hot", pa.binary()), ("hot_levels", pa.binary())])


class Filter:
    """Segments of the filter over one array of bytes; probing gives levels."""

    def __init__(self, segments: int, place: list[tuple[int, int, int]], probes: np.ndarray, bits: np.ndarray):
        """place: (segment, first byte, bytes) of the segments that are here."""
        self.segments, self.probes, self.bits = segments, probes, bits
        seg, at, n = np.array(place, np.int64).reshape(-1, 3).T
        self.first = int(seg.min(initial=segments - 1))
        self.base, self.size = np.zeros((2, int(seg.max(initial=self.first)) - self.first + 1), U64)
        self.base[seg - self.first], self.size[seg - self.first] = at * 8, n * 8

    @staticmethod
    def opened(segments: int, probes: np.ndarray, path: str | None) -> Filter:
        """The segments of a file of _lay_out; none without a path."""
        if not path:
            return Filter(segments, [], probes, np.zeros(1, np.uint8))
        bits = mapped(path)
        n = int(bits[-8:].copy().view(np.int64)[0])
        return Filter(segments, bits[len(bits) - 24 * n - 8 : -8].copy().view(np.int64).reshape(-1, 3), probes, bits)

    def level(self, pairs: np.ndarray) -> np.ndarray:
        """The level of each pair, 0 for those not found; pairs of segments that are not here count as not found."""
        out = np.zeros(len(pairs), np.int64)
        seg = segment_of(pairs, self.segments) - self.first
        live = np.flatnonzero((seg >= 0) & (seg < len(self.size)))
        live = live[self.size[seg[live]] > 0]
        for q, probes in enumerate(self.probes, 1):
            k, base, size = pairs[live], self.base[seg[live]], self.size[seg[live]]
            a = mix(k + U64(q * STEP % 2**64))
            b = (a >> U64(32)) | U64(1)
            for j in range(probes):
                if not len(live):
                    return out
                at = base + (((a + U64(j) * b) & U64(0xFFFFFFFF)) * size >> U64(32))
                hit = (self.bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & np.uint8(1) > 0
                if not hit.all():
                    live, a, b, base, size = live[hit], a[hit], b[hit], base[hit], size[hit]
            out[live] = q
        return out


def mapped(path: str) -> np.ndarray:
    """The bytes of a filter file in the shared folder. On a mounted folder all workers of a machine share the pages; from any other store the file, of max_filter_bytes about, is read into memory."""
    fs, place = store(path)
    if fs.type_name == "local":
        return np.asarray(np.memmap(place, np.uint8, "r"))
    with fs.open_input_file(place) as f:
        return np.frombuffer(f.read(), np.uint8)


class Model:
    """The logarithm of p(b after a) from levels."""

    def __init__(self, classes: Classes, levels: np.ndarray, mu: float, share: float, margin: float):
        self.classes = classes
        self.mu, self.share, self.margin = mu, share, margin
        self.joint = np.concatenate(([0, 0], levels[1:] - 1)).astype(float)  # by level: its lower bound less one

    def log10(self, pairs: np.ndarray, level: np.ndarray) -> np.ndarray:
        counts = self.classes.counts
        a, b = (pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.int64)
        context = counts[a].astype(float)
        joint = np.minimum(self.joint[level], np.minimum(context, counts[b]))
        return np.log10((joint + (self.mu + self.share * context) * self.classes.unigram[b]) / ((1 + self.share) * context + self.mu + self.margin))


class LogFrequencyBloom:
    """A language model of words and pairs. Fit once, then score any frame of texts."""

    def __init__(self, growth: float = 1.5, probes: int = 8, sure_probes: int = 24, sure_from: int = 32, bits_per_probe: float = 1.5, mu: float = 100.0, share: float = 0.5, max_filter_bytes: int = 256 << 20, head_words: int = 300_000, rare_classes: int = 1 << 18, ngrams_per_segment: int = 1_000_000, most_passes: int = 4, hot_pairs: int = 2_000_000):
        """rare_classes: a power of two. probes: bits an item sets at a level; levels from the count sure_from on, where a raised level would weigh most, set sure_probes."""
        self.levels = thresholds(growth)
        self.probes = np.where(self.levels < sure_from, probes, sure_probes)
        self.bits_per_probe, self.mu, self.share = bits_per_probe, mu, share
        self.max_filter_bytes, self.head_words, self.ngrams_per_segment = max_filter_bytes, head_words, ngrams_per_segment
        self.rare_classes, self.most_passes, self.hot_pairs = rare_classes, most_passes, hot_pairs
        self.table, self.is_word = byte_table(SEED), separator_mask()

    def fit(self, texts: DataFrame, text_col: str = "text") -> LogFrequencyBloom:
        """Learns from all rows; a null text counts as empty, repeated rows count as often as they are there."""
        self.fit_words(texts, text_col)
        return self.fit_pairs(self.encode(texts.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text"))

    def fit_words(self, texts: DataFrame, text_col: str = "text") -> LogFrequencyBloom:
        """Counts the texts' tokens and settles the classes."""
        counted = texts.select(F.col(text_col).alias("text")).mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        self.vocab = written(counted.where("n > 0"), "lm-words")
        is_end = F.col("word") == F.lit(b"\n")
        sums = self.vocab.groupBy(F.when(is_end, -1).otherwise(F.floor(F.log2("n"))).alias("q")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()  # a row for each power of two
        self.n_tokens, self.n_types = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
        self.n_docs = sum(r["n"] for r in sums if r["q"] == -1)
        fit, self.head_from = 0, 2**62
        for r in sorted((r for r in sums if r["q"] >= 0), key=lambda r: -r["q"]):
            fit += r["v"]
            if fit > self.head_words:
                break
            self.head_from = 2 ** r["q"]
        head = self.vocab.where((F.col("n") >= self.head_from) & ~is_end).toArrow()  # head_words rows at most
        keys = word_keys(head.column("word").to_pylist(), self.table, self.is_word)
        order = np.argsort(keys)
        v_rare = self.n_types - len(keys) - (self.n_docs > 0)
        classes = min(self.rare_classes, 1 << max(0, (v_rare // 4 - 1).bit_length()))
        rare = self.vocab.where((F.col("n") < self.head_from) & ~is_end).mapInArrow(count_rare(self.table, self.is_word, classes), "class int, n long, v long")
        rare = rare.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()  # rare_classes rows at most
        n_v = np.zeros((2, classes), np.int64)
        n_v[:, rare.column("class").to_numpy()] = rare.column("n").to_numpy(), rare.column("v").to_numpy()
        self.classes = Classes(keys[order], np.asarray(head.column("n").to_numpy(), np.int64)[order], self.n_docs, self.n_tokens, *n_v)
        self.sent_classes = texts.sparkSession.sparkContext.broadcast(self.classes)
        return self

    @property
    def bottom(self) -> float:
        return float(self.n_tokens + self.n_types + 1)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> DataFrame:
        """A written table of the rows' class numbers and rare words; train marks rows for fit_pairs (all, if not given)."""
        kind = docs.schema[id_col].dataType.simpleString()
        rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), (F.lit(True) if train is None else train).alias("train"), F.col(text_col).alias("text"))
        return written(rows.mapInArrow(encoder(self.sent_classes, self.table, self.is_word, self.bottom), ENCODED.format(kind)), "lm-encoded")

    def fit_pairs(self, encoded: DataFrame) -> LogFrequencyBloom:
        """Builds the filter from the encoded rows that are marked for training."""
        self.segments = max(1, -(-self.n_tokens // self.ngrams_per_segment))
        runs = encoded.where("train").select("ids").mapInArrow(count_pairs(self.segments, self.classes.start, self.classes.end), "seg int, pairs binary, counts binary")
        filled = written(runs.groupBy("seg").applyInArrow(fill_segment(self.levels, self.probes, self.bits_per_probe, self.segments, self.n_tokens // self.hot_pairs + 1), "seg int, bits binary, n_bytes long, n_set long, hot binary, hot_levels binary"), "lm-filter")
        whole = filled.agg(F.sum("n_bytes").alias("n"), F.sum("n_set").alias("ones")).collect()[0]
        n_bytes = whole["n"] or 0
        miss = ((whole["ones"] or 0) / (8 * n_bytes) if n_bytes else 0.0) ** int(self.probes[0])
        false = self.classes.successors * miss**2  # classes that would look like successors of any one, with a J of at least 1
        self.model = Model(self.classes, self.levels, self.mu, self.share, false + 6 * false**0.5 + 16)
        self.filled, self.files = filled, self._lay_out(filled, min(self.segments, max(1, -(-n_bytes // self.max_filter_bytes))))
        return self

    def _lay_out(self, filled: DataFrame, n_files: int) -> list[str | None]:
        """Writes the segments into n_files files of nearly equal ranges of segments, each with (segment, first byte, bytes) of all behind them and their number last; no path for a range without pairs."""
        spark = filled.sparkSession
        folder, segments = scratch_path(spark, "lm-files"), self.segments

        def run(batches):
            fs, root = store(folder)
            fs.create_dir(root, recursive=True)
            out, last, names, place = None, None, {}, []

            def close():
                if out:
                    out.write(np.array(place, np.int64).tobytes() + np.int64(len(place)).tobytes())
                    out.close()

            for b in batches:
                for part, seg, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    if part != last:
                        close()
                        names[part], last, place = f"{uuid.uuid4().hex}.bits", part, []
                        out = fs.open_output_stream(f"{root}/{names[part]}")
                    data = bits.as_buffer()
                    out.write(data)
                    place.append((seg, sum(place[-1][1:]) if place else 0, data.size))
            close()
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(names), pa.int64()), "name": pa.array(list(names.values()), pa.string())})

        part = F.expr(f"cast(seg as bigint) * {n_files} div {segments}")
        laid = filled.select(part.alias("part"), "seg", "bits").repartition(n_files, "part").sortWithinPartitions("part", "seg")
        files: list[str | None] = [None] * n_files
        for r in written(laid.mapInArrow(run, "part long, name string"), "lm-names").collect():  # a name for each file
            files[r["part"]] = f"{folder}/{r['name']}"
        return files

    def filter(self, k: int = 0) -> Filter:
        """The k-th file's range of segments."""
        return Filter.opened(self.segments, self.probes, self.files[k])

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, n_tokens, n_known, train_tokens, base_score, score for each row; a null text counts as empty.

        Repeated ids and texts are scored row by row. Other columns are left out, so their names can't clash."""
        return self.score_encoded(self.encode(docs, id_col, text_col), id_col)

    def score_encoded(self, encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
        base = ["uid", "id", "n_tokens", "head_known", "head_sum", "shift"]
        kind = encoded.schema["id"].dataType.simpleString()
        shape = f"uid long, id {kind}, n_tokens long, head_known long, head_sum double, shift double, score double"
        if len(self.files) > self.most_passes:
            scored = encoded.select(*base, F.lit(0.0).alias("score")).unionByName(self._by_file(encoded), allowMissingColumns=True)
        else:
            scored = None
            for k in range(len(self.files)):
                one = encoded.select(*base, "ids").mapInArrow(self._scorer(k), shape)
                scored = one if scored is None else scored.unionByName(one)
        if len(self.files) > 1:
            scored = scored.groupBy("uid").agg(*(F.max(c).alias(c) for c in base[1:]), F.sum("score").alias("score"))
        tail = encoded.where(F.size("tail") > 0).select("uid", F.explode("tail").alias("t")).select("uid", "t.word", F.col("t.n").alias("tf"))
        rare = self.vocab.where(F.col("n") < self.head_from).select("word", F.col("n").alias("c"))
        c = F.coalesce("c", F.lit(0))
        tail = tail.join(rare, "word", "left").groupBy("uid").agg(F.sum(F.col("tf") * F.log10((c + 1) / F.lit(self.bottom))).alias("tail_sum"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
        none = F.lit(0.0)
        return scored.join(tail, "uid", "left").select(
            F.col("id").alias(id_col),
            "n_tokens",
            (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
            F.lit(self.n_tokens).cast("long").alias("train_tokens"),
            (F.col("head_sum") + F.coalesce("tail_sum", none)).alias("base_score"),
            (F.col("score") + F.coalesce("tail_sum", none) + F.col("shift")).alias("score"),
        )

    def _scorer(self, k: int):
        """Adds up the logarithms of the pairs whose segments are in the k-th file's range; a text's other pairs are left to the other files."""
        sent, n_files = self.sent_classes, len(self.files)
        path, segments, probes = self.files[k], self.segments, self.probes
        levels, mu, share, margin = self.levels, self.mu, self.share, self.model.margin

        def run(batches):
            own = Model(sent.value, levels, mu, share, margin)
            filter_ = Filter.opened(segments, probes, path)
            for batch in batches:
                for x, pairs, at in neighbours(batch.column(6), own.classes.start, own.classes.end):
                    kinds, which = np.unique(pairs, return_inverse=True)
                    p = own.log10(kinds, filter_.level(kinds))
                    if n_files > 1:
                        p = np.where(segment_of(kinds, segments) * n_files // segments == k, p, 0.0)
                    part = batch.slice(x, len(at) - 1)
                    rest = [part.column(c) if k == 0 else pa.nulls(part.num_rows, part.column(c).type) for c in range(1, 6)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *rest, pa.array(per_doc(p[which], at))], ["uid", "id", "n_tokens", "head_known", "head_sum", "shift", "score"])

        return run


    def _by_file(self, encoded: DataFrame, salts: int = 16) -> DataFrame:
        """uid, score: parts of each row's sum of logarithms, by one shuffle of pairs to the filter's files."""
        spark = encoded.sparkSession
        hot = self.filled.where("length(hot) > 0").select("hot", "hot_levels").toArrow()  # hot_pairs pairs at most, nine bytes each
        pairs, level = (np.frombuffer(b"".join(hot.column(c).to_pylist()), t) for c, t in (("hot", U64), ("hot_levels", np.uint8)))
        order = np.argsort(pairs)
        sent_hot = spark.sparkContext.broadcast((pairs[order], level[order]))
        sent, files, segments, probes = self.sent_classes, self.files, self.segments, self.probes
        levels, mu, share, margin = self.levels, self.mu, self.share, self.model.margin

        def spread(batches):
            own = Model(sent.value, levels, mu, share, margin)
            hot_pairs, hot_levels = sent_hot.value
            for batch in batches:
                for x, pairs, at in neighbours(batch.column(1), own.classes.start, own.classes.end):
                    uid = batch.column(0).slice(x, len(at) - 1).to_numpy()
                    kinds, which = np.unique(pairs, return_inverse=True)
                    k = np.minimum(np.searchsorted(hot_pairs, kinds), max(0, len(hot_pairs) - 1))
                    known = hot_pairs[k] == kinds if len(hot_pairs) else np.zeros(len(kinds), bool)
                    p = np.zeros(len(kinds))
                    p[known] = own.log10(kinds[known], hot_levels[k[known]].astype(np.int64))
                    mark = mix(uid[:1].astype(U64))[0] >> U64(33)
                    rows = [(-1, int(mark), uid.tobytes(), b"", per_doc(p[which], at).tobytes())]  # answered here
                    far = np.flatnonzero(~known[which])
                    doc = np.searchsorted(at, far, "right") - 1
                    each, times = np.unique(doc * len(kinds) + which[far], return_counts=True)
                    doc, kind = each // len(kinds), kinds[each % len(kinds)]
                    part = segment_of(kind, segments) * len(files) // segments
                    order = np.argsort(part, kind="stable")
                    doc, kind, part, times = doc[order], kind[order], part[order], times[order]
                    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else part
                    rows += [(int(part[i]), int(mark % U64(salts)), uid[doc[i:j]].tobytes(), kind[i:j].tobytes(), times[i:j].astype("<u4").tobytes()) for i, j in zip(cut, [*cut[1:], len(part)])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "salt", "uids", "pairs", "n"])

        def probe(batches):
            own, filter_, last = Model(sent.value, levels, mu, share, margin), None, None
            for batch in batches:
                uids, logs = [np.zeros(0, np.int64)], [np.zeros(0)]
                for part, uid, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("part", "uids", "pairs", "n"))):
                    uids.append(np.frombuffer(uid, np.int64))
                    if part < 0:
                        logs.append(np.frombuffer(n, float))
                        continue
                    if part != last:
                        filter_, last = Filter.opened(segments, probes, files[part]), part
                    pairs = np.frombuffer(pairs, U64)
                    logs.append(own.log10(pairs, filter_.level(pairs)) * np.frombuffer(n, "<u4"))
                uid, p = sum_by(np.concatenate(uids), np.concatenate(logs))
                yield pa.RecordBatch.from_pydict({"uid": pa.array(uid, pa.int64()), "score": pa.array(p, pa.float64())})

        rows = encoded.select("uid", "ids").mapInArrow(spread, "part int, salt int, uids binary, pairs binary, n binary")
        return rows.repartition(F.col("part"), F.col("salt")).sortWithinPartitions("part").mapInArrow(probe, "uid long, score double")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = held_out("doc_id", 7, 2)
    model = LogFrequencyBloom().fit_words(docs.where(~left))
    encoded = model.encode(docs, train=~left)
    scored = model.fit_pairs(encoded).score_encoded(encoded)
    return scored.select("doc_id", left.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
