"""Quality by nearest-neighbour voting among labelled texts in a latent space.

Features of a text are counts of short sequences of character classes (runs of one class count once) and of repeated
words and lines, hashed to `dims` places: how a text is written, in any language. Counts are damped, weighted by how few labelled texts
have them and projected on the `rank` strongest directions of the labelled texts (latent semantic analysis: the
eigenvectors of their Gram matrix, which is summed on Spark). The labelled vectors, `max_rows` at most, are broadcast; every document
is compared with all of them by matrix products, in blocks, and the labels of its nearest ones are
averaged with weights that grow with the cosine.

Only the classifier is fitted on a sample (`max_rows` labelled ids, those of the smallest hash); every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blocks, byte_table, fresh, held_out, mix, separator_mask, ship, utf8, word_spans, written

ship(__name__)

MARKS = b".,!?%*$&#|:;-_()[]{}<>/\\\"'=+@~^`"
NEAR = 1e-9  # cosines that differ by less are equal


def class_table() -> np.ndarray:
    """0 for white space and control characters, 1 lower case and all beyond ASCII, 2 upper case, 3 digits, a class for each mark."""
    table = np.zeros(256, np.uint8)
    table[97:123] = table[128:] = 1
    table[65:91], table[48:58] = 2, 3
    table[list(MARKS)] = np.arange(4, 4 + len(MARKS))
    return table


def counts(docs: list[bytes], dims: int, longest: int = 4) -> np.ndarray:
    """Feature counts, a row for each text; a text without bytes has none."""
    classes, words, lines = class_table(), separator_mask(), np.ones(256, bool)
    lines[10] = False
    size = np.array([len(d) for d in docs], np.int64)
    of = np.repeat(np.arange(len(docs)), size)
    c = classes[np.frombuffer(b"".join(docs), np.uint8)]
    head = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (of[1:] != of[:-1])))[: len(c)])
    c, of = c[head].astype(U64), of[head]
    found, text = [], []
    h = np.zeros(len(c), U64)
    for n in range(1, longest + 1):
        h = (h[: len(c) - n + 1] * U64(131) + c[n - 1 :] + U64(1)) if len(c) >= n else h[:0]
        same = of[n - 1 :] == of[: len(of) - n + 1] if len(of) >= n else np.zeros(0, bool)
        found.append(mix(h[same] * U64(8) + U64(n)))
        text.append(of[: len(same)][same])
    for kind, mask in enumerate((words, lines)):
        *_, w, first = word_spans(docs, mask, byte_table(31 + kind, fold=False))
        own = np.repeat(np.arange(len(docs)), np.diff(first))
        if kind == 0:  # the word before
            again = np.concatenate(([False], (w[1:] == w[:-1]) & (own[1:] == own[:-1])))[: len(w)]
        else:  # any line before
            order = np.lexsort((np.arange(len(w)), w, own))
            again = np.zeros(len(w), bool)
            again[order[1:]] = (w[order[1:]] == w[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
        found.append(mix(U64(0x9FB21C651E98DF25 + 2 * kind) + again.astype(U64)))
        text.append(own)
    at = np.concatenate(text) * dims + (np.concatenate(found) & U64(dims - 1)).astype(np.int64)
    return np.bincount(at, minlength=len(docs) * dims).reshape(len(docs), dims)


def in_blocks(texts: pa.Array, dims: int, most: int = 1_000_000, rows: int = 250):
    """Feature counts of the texts, block by block, as floats."""
    docs = utf8(texts)
    for i, j in blocks([max(len(d), most // rows) for d in docs], most):
        yield counts(docs[i:j], dims).astype(float)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int, power: int, prior: float) -> np.ndarray:
    """Labels of the nearest known vectors, weighted by a power of the cosine. All that are as near as the last of the nearest count; without a cosine above 0, the prior."""
    out = np.full(len(vectors), prior)
    step = max(1, 2_000_000 // max(1, len(known)))
    for i in range(0, len(vectors) if len(known) else 0, step):
        cosine = vectors[i : i + step] @ known.T
        k = min(neighbours, len(known))
        last = np.partition(cosine, len(known) - k, axis=1)[:, len(known) - k]
        weight = np.where(cosine >= last[:, None] - NEAR, np.maximum(cosine, 0), 0) ** power
        total = weight.sum(1)
        some = total > NEAR
        out[i : i + step][some] = np.clip((weight[some] @ labels) / total[some], 0, 1)
    return out


class NeighbourQuality:
    def __init__(self, dims: int = 1024, rank: int = 32, neighbours: int = 15, power: int = 4, max_rows: int = 6_000):
        assert dims & (dims - 1) == 0
        self.dims, self.rank, self.neighbours, self.power, self.max_rows = dims, rank, neighbours, power, max_rows
        self.weight, self.axes = np.zeros(dims), np.zeros((dims, rank))
        self.known, self.labels, self.prior = np.zeros((0, rank)), np.zeros(0), 0.5

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> NeighbourQuality:
        """Labels of null or other than 0 and 1 are left out, as are labels without a text. Without labels every score is 0.5.

        An id with several labels counts once, as 0 if one of them says so. Where several rows have that id, the
        text of the lowest hash stands for it, so that the sample never has more than max_rows rows."""
        dims = self.dims
        one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
        picked = one.withColumn("o", F.xxhash64("id")).orderBy("o", "id").limit(self.max_rows)
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # max_rows ids at most
        rows = rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("y").alias("y"), F.first("o").alias("o"))

        def damped(batches):
            for b in batches:
                out = [row.astype("<f4").tobytes() for x in in_blocks(b.column(0), dims) for row in np.log1p(x)]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.binary())], ["y", "o", "x"])

        sample = written(rows.select("text", "y", "o").mapInArrow(damped, "y int, o long, x binary"), "quality-sample")
        matrix = lambda column: np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dims).astype(float)

        def having(batches):
            total, n = np.zeros(dims, np.int64), 0
            for b in batches:
                total += (matrix(b.column(0)) > 0).sum(0)
                n += b.num_rows
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dims + 1), pa.int32()), "n": np.append(total, n)})

        have = sample.select("x").mapInArrow(having, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # dims + 1 rows
        if have.empty or not have.n.max():
            return self
        have = have.sort_values("i").n.to_numpy()
        n, have = have[-1], have[:-1]
        self.weight = np.where(have > 0, np.log((1 + n) / np.maximum(have, 1)), 0.0)
        weight = self.weight

        def gram(batches):
            total = np.zeros((dims, dims))
            for b in batches:
                x = unit(matrix(b.column(0)) * weight)
                total += x.T @ x
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dims), pa.int32()), "row": pa.array([r.tobytes() for r in total], pa.binary())})

        def added(key, group):
            rows = sorted(group.column("row").to_pylist())
            return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([np.sum([np.frombuffer(r) for r in rows], axis=0).tobytes()], pa.binary())})

        summed = sample.select("x").mapInArrow(gram, "i int, row binary").groupBy("i").applyInArrow(added, "i int, row binary").toPandas().sort_values("i")  # dims rows
        _, axes = np.linalg.eigh(np.frombuffer(b"".join(summed.row)).reshape(dims, dims))
        self.axes = axes = axes[:, ::-1][:, : self.rank]

        def project(batches):
            for b in batches:
                v = unit(unit(matrix(b.column(2)) * weight) @ axes)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in v], pa.binary())], ["y", "o", "v"])

        known = sample.mapInArrow(project, "y int, o long, v binary").toPandas().sort_values(["o", "v"])  # max_rows rows
        self.known, self.labels = np.frombuffer(b"".join(known.v)).reshape(len(known), -1), known.y.to_numpy().astype(float)
        self.prior = float(self.labels.mean())
        return self

    def score(self, docs: DataFrame, text_col: str = "text", out_col: str = "score") -> DataFrame:
        """Adds out_col, 0 to 1 (higher: label 1 likelier), to every row, with underscores behind its name where the frame has that column already; all other columns stay.
        A null or empty text has no features: its score is the share of label 1. Repeated rows are scored alike; an empty table gives an empty one."""
        out_col = fresh(docs, out_col)
        dims, neighbours, power, prior = self.dims, self.neighbours, self.power, self.prior
        sent = docs.sparkSession.sparkContext.broadcast((self.weight, self.axes, self.known, self.labels))  # dims x rank and max_rows x rank numbers

        def scores(texts: pa.Array) -> pa.Array:
            weight, axes, known, labels = sent.value
            out = [vote(unit((np.log1p(x) * weight) @ axes), known, labels, neighbours, power, prior) for x in in_blocks(texts, dims)]
            return pa.array(np.concatenate(out) if out else np.zeros(0))

        return docs.withColumn(out_col, F.arrow_udf(scores, "double")(F.col(text_col)))


def op12_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = NeighbourQuality().fit(docs, labels.where(~held_out("doc_id", 4, 2)))
    return model.score(docs).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
