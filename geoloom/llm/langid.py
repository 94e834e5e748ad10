"""Language identification by segmentation-marginalised unigrams.

The pieces come from a public SentencePiece vocabulary and are fixed; each language has its own
probabilities of them, fitted by expectation maximisation over all segmentations. A text's
likelihood is the product of its words' likelihoods, and a word's is the sum over all its
segmentations (forward algorithm), so nothing depends on one best segmentation. Pieces never
cross words (maximal runs of letters and marks, in lower case), hence the product is exact.

Single bytes are pieces of the vocabulary too, so every word has a segmentation. Words may be of any
length, as they are in scripts without spaces: long ones are summed in logarithms.

On Spark: a bounded sample of distinct texts for each language (about `max_docs`, those of the smallest
hashes, so that the sample is a property of the texts) is reduced to word counts by
a shuffle; each EM round is one pass over these counts and one aggregation to pieces by
languages. Scoring sends that matrix (vocabulary x languages) and works word by distinct word.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, byte_table, fresh, held_out, ship, written

ship(__name__)

WORD = regex.compile(r"[\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def vocabulary(path: str) -> list[bytes]:
    """Lower-case pieces as bytes, a space standing for the start of a word, and all single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i)
        text = piece.replace("▁", " ")
        if " " not in text[1:] and text == text.lower():
            out.add(text.encode())
    return sorted(out)


class Lattice:
    """Finds the vocabulary's pieces in many words of one length at once."""

    def __init__(self, pieces: list[bytes]):
        self.table = byte_table(31, fold=False)
        self.longest = max(map(len, pieces))
        self.base = U64(0x9E3779B97F4A7C15)
        keys = np.array([self._hash(np.frombuffer(p, np.uint8)[None, :])[0] for p in pieces], U64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.lengths = np.bincount([len(p) for p in pieces], minlength=self.longest + 1) > 0

    def _hash(self, rows: np.ndarray) -> np.ndarray:
        h = np.full(len(rows), rows.shape[1], U64)
        for k in range(rows.shape[1]):
            h = h * self.base + self.table[rows[:, k]]
        return h ^ (h >> U64(29))

    def arcs(self, words: np.ndarray):
        """For each start and length: (start, end, which words, which pieces)."""
        n = words.shape[1]
        codes = self.table[words]
        for i in range(n):
            raw = None
            for size in range(1, min(self.longest, n - i) + 1):
                raw = (np.zeros(len(words), U64) if raw is None else raw * self.base) + codes[:, i + size - 1]
                if not self.lengths[size]:
                    continue
                h = raw + U64(size * pow(0x9E3779B97F4A7C15, size, 2**64) % 2**64)
                h ^= h >> U64(29)
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == h)
                if len(hit):
                    yield i, i + size, hit, self.order[at[hit]]


def by_length(words: list[str], most: int = 4000):
    """(positions, byte matrix) of words of equal length, in blocks; a space is put in front."""
    raw = [b" " + w.encode("utf-8", "replace") for w in words]
    size = np.array([len(r) for r in raw])
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for same in np.split(order, cut) if len(order) else []:
        n = int(size[same[0]])
        step = max(1, min(most, 1_000_000 // n))
        for k in range(0, len(same), step):
            at = same[k : k + step]
            yield at, np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)


def forward(lattice: Lattice, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over all segmentations, by word and language; p: pieces x languages."""
    w, n = rows.shape
    live = {0: np.ones((w, p.shape[1]))}
    shift = np.zeros((w, p.shape[1]))
    for i, j, hit, piece in lattice.arcs(rows):
        if j not in live:
            live[j] = np.zeros((w, p.shape[1]))
        if i - 1 in live:  # all arcs into i are done: nothing before i is used again
            del live[i - 1]
            if i % 8 == 0:
                most = live[i].copy()
                for k in live:
                    np.maximum(most, live[k], out=most)
                most[most == 0] = 1
                for k in live:
                    live[k] /= most
                shift += np.log(most)
        live[j][hit] += live[i][hit] * p[piece]
    return np.log(live[n]) + shift


def expected(lattice: Lattice, rows: np.ndarray, p: np.ndarray, n: np.ndarray, plain: int = 64) -> np.ndarray:
    """Expected counts of the pieces in words of one language, each counted n times. Words of more than `plain` bytes, whose products might vanish, are summed in logarithms; the sums are the same."""
    w, size = rows.shape
    arcs = list(lattice.arcs(rows))
    out = np.zeros(len(p))
    if size <= plain:
        ahead, back = np.zeros((size + 1, w)), np.zeros((size + 1, w))
        ahead[0] = back[size] = 1
        for i, j, hit, piece in arcs:
            ahead[j, hit] += ahead[i, hit] * p[piece]
        for i, j, hit, piece in reversed(arcs):
            back[i, hit] += back[j, hit] * p[piece]
        share = n / ahead[size]
        for i, j, hit, piece in arcs:
            out += np.bincount(piece, ahead[i, hit] * p[piece] * back[j, hit] * share[hit], len(p))
        return out
    logs = np.log(p)
    ahead, back = np.full((size + 1, w), -np.inf), np.full((size + 1, w), -np.inf)
    ahead[0] = back[size] = 0
    for i, j, hit, piece in arcs:
        ahead[j, hit] = np.logaddexp(ahead[j, hit], ahead[i, hit] + logs[piece])
    for i, j, hit, piece in reversed(arcs):
        back[i, hit] = np.logaddexp(back[i, hit], back[j, hit] + logs[piece])
    for i, j, hit, piece in arcs:
        np.add.at(out, piece, np.exp(ahead[i, hit] + logs[piece] + back[j, hit] - ahead[size, hit]) * n[hit])
    return out


def fold(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def e_step(sent_pieces, sent):
    """Expected piece counts by language over a task's (lang, word, n) rows."""

    def run(batches):
        lattice, q = Lattice(sent_pieces.value), sent.value
        total = np.zeros((q.shape[1], len(q)))
        for b in batches:
            lang, n = b.column(0).to_numpy(), b.column(2).to_numpy().astype(float)
            words = b.column(1).to_pylist()
            for k in np.unique(lang):
                own = np.flatnonzero(lang == k)
                for at, rows in by_length([words[i] for i in own]):
                    total[k] += expected(lattice, rows, q[:, k], n[own[at]])
        k, i = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(k, pa.int32()), "piece": pa.array(i, pa.int32()), "n": total[k, i]})

    return run


class LanguageModel:
    def __init__(self, vocab_path: str, max_docs: int = 2000, rounds: int = 4, smooth: float = 0.01, cache_words: int = 400_000):
        self.pieces = vocabulary(vocab_path)
        self.max_docs, self.rounds, self.smooth, self.cache_words = max_docs, rounds, smooth, cache_words
        self.langs: list[str] = []
        self.p = np.zeros((len(self.pieces), 0))

    def fit(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
        """Learns from rows with a language; of each about max_docs distinct texts, those of the smallest hashes, so that the sample is bounded."""
        spark, v = docs.sparkSession, len(self.pieces)
        rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
        sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
        self.langs = sorted(sizes)
        if not self.langs:
            return self
        share = F.create_map(*[x for g in self.langs for x in (F.lit(g), F.lit(min(1.0, self.max_docs / sizes[g])))])
        drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003
        place = {g: k for k, g in enumerate(self.langs)}

        def count(batches):
            for b in batches:
                by: dict[str, Counter] = {}
                for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    by.setdefault(lang, Counter()).update(fold(text))
                for lang, c in by.items():
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([place[lang]] * len(c), pa.int32()), "word": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

        words = written(rows.where(drawn).dropDuplicates(["text", "lang"]).mapInArrow(count, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
        sent_pieces = spark.sparkContext.broadcast(self.pieces)
        p = np.full((v, len(self.langs)), 1.0 / v)
        for _ in range(self.rounds):
            sent = spark.sparkContext.broadcast(p)
            got = words.mapInArrow(e_step(sent_pieces, sent), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()  # vocabulary x languages at most
            e = np.full((v, len(self.langs)), self.smooth)
            e[got.column("piece").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
            p = e / e.sum(0)
            sent.destroy()
        self.p = p
        return self

    def predict(self, docs: DataFrame, text_col: str = "text", out_col: str = "language") -> DataFrame:
        """Adds out_col, a struct of lang and score (the winner's share of the likelihoods), with underscores behind its name where the frame has that column already.

        Without letters (null and empty texts too) or without languages learned: und, 0. Ties: the first name. Repeated rows and other columns stay."""
        spark, out_col = docs.sparkSession, fresh(docs, out_col)
        sent = spark.sparkContext.broadcast((self.pieces, self.langs, self.p))
        most = self.cache_words

        def run(batches):
            pieces, langs, p = sent.value
            lattice = Lattice(pieces)
            index: dict[str, int] = {}
            logs = np.zeros((0, len(langs)))
            for texts in batches:
                every = texts.to_pylist()
                lang_out, score_out = [], []
                for begin in range(0, len(every), 2000):
                    split = [fold(t) for t in every[begin : begin + 2000]]
                    if len(index) > most:
                        index, logs = {}, np.zeros((0, len(langs)))
                    new = list(set().union(*split).difference(index))
                    if new and langs:
                        more = np.zeros((len(new), len(langs)))
                        for at, mat in by_length(new):
                            more[at] = forward(lattice, mat, p)
                        index.update(zip(new, range(len(logs), len(logs) + len(new))))
                        logs = np.concatenate((logs, more))
                    for words, text in zip(split, every[begin : begin + 2000]):
                        if not langs or not words or not LETTER.search(text):
                            lang_out.append(UNKNOWN)
                            score_out.append(0.0)
                            continue
                        total = logs[np.fromiter(map(index.__getitem__, words), np.int64, len(words))].sum(0)
                        k = int(total.argmax())
                        lang_out.append(langs[k])
                        score_out.append(float(1 / np.exp(total - total[k]).sum()))
                yield pa.StructArray.from_arrays([pa.array(lang_out, pa.string()), pa.array(score_out, pa.float64())], ["lang", "score"])

        from collections.abc import Iterator

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return docs.withColumn(out_col, F.arrow_udf(run, "lang string, score double")(F.col(text_col)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = LanguageModel(public_tokenizers.path("piece_bpe_32k.model")).fit(docs.where(~held_out("doc_id", 5, 0)))
    got = model.predict(docs.select("doc_id", "text"))
    return got.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
