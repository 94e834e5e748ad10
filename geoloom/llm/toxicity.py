"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

Training runs on a bounded sample of labelled rows (`max_rows`, those with the smallest id hash).
The sample is dealt to `shards` tasks; in each round every shard runs some epochs of per-coordinate
FTRL from the shared state, and coordinates are then averaged over the shards that touched them
(iterative parameter mixing, one Spark aggregation per round). One shard, the default, is plain
FTRL over the sample; more shards train in parallel on larger samples, at some loss of recall. The L1 term leaves few weights: their indexes and values are all that scoring
broadcasts, at most `dims` of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, byte_table, fresh, held_out, mix, separator_mask, ship, utf8, word_spans, written

ship(__name__)

LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
KINDS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD1342543DE82EF95)


def features(docs: list[bytes], dims: int, table: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) for each word, neighbouring pair and pair with one word between, in the order of the kinds."""
    *_, h, first = word_spans(docs, mask, table)
    doc = np.repeat(np.arange(len(docs)), np.diff(first))
    keep = U64(dims - 1)
    found, of = [np.zeros(len(docs), np.int32), (mix(h ^ U64(KINDS[0])) & keep).astype(np.int32)], [np.arange(len(docs)), doc]  # feature 0 is in every text
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        pair = mix(h[:-gap][same] * U64(KINDS[gap]) + h[gap:][same])
        found.append((pair & keep).astype(np.int32))
        of.append(doc[gap:][same])
    return np.concatenate(found), np.concatenate(of)


class Ftrl:
    """FTRL-proximal with per-coordinate rates (McMahan et al. 2013) on binary features."""

    def __init__(self, dims: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dims), np.zeros(dims)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def count_features(dims: int):
    def run(batches):
        total = np.zeros(dims, np.int64)
        for b in batches:
            for f in b.column(0).to_pylist():
                total[np.frombuffer(f, "<i4")] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()), "n": total[at]})

    return run


def prune_features(sent):
    def run(batches):
        for b in batches:
            lists = [np.frombuffer(f, "<i4") for f in b.column("f").to_pylist()]
            f = pa.array([x[sent.value[x]].tobytes() for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([f if n == "f" else b.column(n) for n in b.schema.names], b.schema.names)

    return run


def one_round(state, dims: int, rates: tuple, epochs: int):
    """A shard's passes over its rows, from the shared state; returns the coordinates it touched."""

    def run(key, group):
        own = Ftrl(dims, *rates)
        own.z, own.n = state.value[0].copy(), state.value[1].copy()
        touched = np.zeros(dims, bool)
        y, f = group.column("y").to_pylist(), group.column("f").to_pylist()
        order = np.argsort(group.column("o").to_numpy(), kind="stable")
        for i in np.tile(order, epochs):
            at = np.frombuffer(f[i], "<i4")
            own.learn(at, y[i])
            touched[at] = True
        at = np.flatnonzero(touched)
        return pa.table({"i": pa.array(at, pa.int32()), "z": own.z[at], "n": own.n[at]})

    return run


class ToxicityModel:
    def __init__(self, dims: int = 1 << 20, alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1e-3, rounds: int = 1, epochs: int = 6, shards: int = 1, max_rows: int = 12_000):
        assert dims & (dims - 1) == 0
        self.dims, self.rates, self.rounds, self.epochs, self.shards, self.max_rows = dims, (alpha, beta, l1, l2), rounds, epochs, shards, max_rows
        self.table, self.mask = byte_table(23), separator_mask(LETTERS)
        self.index, self.weight = np.zeros(0, np.int32), np.zeros(0)

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
        """Labels of null or other than 0 and 1 are left out, as are labels without a text. Without labels all weights stay 0.

        An id with several labels counts once, as toxic if one of them says so. Where several rows have that id, the
        text of the lowest hash stands for it, so that the sample never has more than max_rows rows."""
        dims, table, mask, spark = self.dims, self.table, self.mask, docs.sparkSession
        one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
        picked = one.withColumn("o", F.xxhash64("id")).orderBy("o", "id").limit(self.max_rows)
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # max_rows ids at most
        rows = rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("y").alias("y"), F.first("o").alias("o"))

        def listed(batches):
            for b in batches:
                texts = utf8(b.column(0))
                out = []
                for i in range(0, len(texts), 256):
                    f, d = features(texts[i : i + 256], dims, table, mask)
                    both = np.unique(d.astype(np.int64) * dims + f)
                    cut = np.searchsorted(both, np.arange(len(texts[i : i + 256]) + 1) * dims)
                    f = (both & (dims - 1)).astype("<i4")
                    out += [f[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.binary())], ["y", "o", "f"])

        sample = written(rows.select("text", "y", "o").mapInArrow(listed, "y int, o long, f binary").withColumn("shard", F.pmod("o", F.lit(self.shards)).cast("int")), "tox-sample")
        # While a weight is 0 its z is a sum of gradients, each 1 at most: a feature of so few texts never passes L1, so it goes now.
        least = int(self.rates[2] // (self.rounds * self.epochs)) + 1
        often = sample.select("f").mapInArrow(count_features(dims), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("i").toArrow()  # dims rows at most
        kept = np.zeros(dims, bool)
        kept[often.column("i").to_numpy()] = True
        sent = spark.sparkContext.broadcast(kept)
        sample = written(sample.mapInArrow(prune_features(sent), sample.schema), "tox-pruned")
        model = Ftrl(dims, *self.rates)
        for _ in range(self.rounds):
            state = spark.sparkContext.broadcast((model.z, model.n))
            new = sample.groupBy("shard").applyInArrow(one_round(state, dims, self.rates, self.epochs), "i int, z double, n double").groupBy("i").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()  # dims rows at most
            at = new.column("i").to_numpy()
            model.z[at], model.n[at] = new.column("z").to_numpy(), new.column("n").to_numpy()
            state.destroy()
        w = model.weights(slice(None))
        self.index = np.flatnonzero(w).astype(np.int32)
        self.weight = w[self.index]
        return self

    def score(self, docs: DataFrame, text_col: str = "text", out_col: str = "score") -> DataFrame:
        """Adds out_col, 0 to 1, to every row, with underscores behind its name where the frame has that column already; all other columns stay. A null or empty text gets the score of the constant feature alone."""
        out_col = fresh(docs, out_col)
        dims, table, mask = self.dims, self.table, self.mask
        sent = docs.sparkSession.sparkContext.broadcast((self.index, self.weight))

        def margins(texts: pa.Array) -> pa.Array:
            index, weight = sent.value
            dense = np.zeros(dims)
            dense[index] = weight
            texts, out = utf8(texts), []
            step = max(1, 1_500_000 // max(1, sum(map(len, texts)) // max(1, len(texts)) + 1))
            for i in range(0, len(texts), step):
                part = texts[i : i + step]
                f, d = features(part, dims, table, mask)
                live = np.flatnonzero(dense[f])
                both = np.unique(d[live].astype(np.int64) * dims + f[live])
                m = np.bincount(both // dims, dense[both & (dims - 1)], len(part))
                out.append(1 / (1 + np.exp(-np.clip(m, -35, 35))))
            return pa.array(np.concatenate(out) if out else np.zeros(0))

        return docs.withColumn(out_col, F.arrow_udf(margins, "double")(F.col(text_col)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ToxicityModel().fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    return model.score(docs).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
