"""Token counts with a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, number of tokens). A frame's
distinct content digests are joined with the cache's entries of the tokenizer version at hand;
one row of each missing content is encoded and the counts are appended. Contents are compared by
SHA-256 of the normalised text, so that copies are encoded once, in whatever task they lie.

Digests are counted and joined with the cache first. A missing text that occurs once is encoded in the
task that reads it; of one that occurs more often, one copy a task is shuffled and one of all is
encoded. Two bitmaps of fixed size tell the tasks which is which, so texts with a count stay where they
are. Bitmaps may hold a few digests too many: what is then encoded in vain is dropped by an exact join.
All keys are digests of the texts, not of the tasks that read them, so a lost executor or another
split of the files changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_keys, fresh, scratch_path, sent_bitmap, ship, written
from .tokens import PretokenIds, tokenizer_version

ship(__name__)

SHAPE = "content binary, tokenizer binary, n_tokens long"


class TokenCounts:
    def __init__(self, spark: SparkSession, tokenizer_path: str, pattern: str, cache_path: str | None = None):
        """cache_path: where the counts are kept from call to call; without it, a new table in the shared folder."""
        self.spark, self.path, self.pattern = spark, tokenizer_path, pattern
        self.version = tokenizer_version(tokenizer_path)
        self.cache_path = cache_path or scratch_path(spark, "token-counts")
        spark.createDataFrame([], SHAPE).write.mode("append").parquet(self.cache_path)

    def cached(self) -> DataFrame:
        """Counts of this tokenizer version. Two runs may have appended the same content: one row for each stays."""
        rows = self.spark.read.schema(SHAPE).parquet(self.cache_path).where(F.hex("tokenizer") == self.version.upper())
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def known(self) -> DataFrame:
        """The same as a table of its own: a join with it can be split where many rows have one content."""
        return written(self.cached(), "token-known")

    def encode_misses(self, docs: DataFrame, text_col: str = "text", bitmap_bits: int = 1 << 26) -> None:
        """Encodes each distinct text that the cache lacks once and appends the counts."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content"))
        counted = rows.groupBy("content").agg(F.count("*").alias("n")).join(self.cached().select("content"), "content", "left_anti")
        missing = written(counted, "token-misses")

        def keys(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"key": pa.array(digest_keys(b.column(0).to_pylist()).view(np.int64))})

        once, more = (sent_bitmap(missing.where(c).select("content").mapInArrow(keys, "key long"), bitmap_bits) for c in ("n = 1", "n > 1"))
        path, pattern, version = self.path, self.pattern, bytes.fromhex(self.version)

        def in_place(batches):
            ids, passed = PretokenIds(path, pattern), {}
            for b in batches:
                for x in range(0, b.num_rows, 500):
                    part = b.slice(x, 500)
                    content = part.column(1).to_pylist()
                    k = digest_keys(content)
                    wait, here = more.value.has(k), once.value.has(k)
                    out = []
                    for i, c in enumerate(content):
                        if wait[i]:
                            if c not in passed:
                                if len(passed) > 200_000:
                                    passed.clear()
                                passed[c] = None
                                out.append((c, None, part.column(0)[i].as_py()))
                        elif here[i]:
                            out.append((c, len(ids.ids(part.column(0)[i].as_py())) // 4, None))
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["content", "n_tokens", "text"])

        def encode(batches):
            ids = PretokenIds(path, pattern)
            for b in batches:
                yield pa.RecordBatch.from_pydict({"content": b.column(0), "n_tokens": pa.array([len(ids.ids(t)) // 4 for t in b.column(1).to_pylist()], pa.int64())})

        first = written(rows.mapInArrow(in_place, "content binary, n_tokens long, text string"), "token-first")
        late = first.where("text is not null").groupBy("content").agg(F.first("text").alias("text")).mapInArrow(encode, "content binary, n_tokens long")
        new = first.where("text is null").select("content", "n_tokens").unionByName(late).join(missing.select("content"), "content", "left_semi")
        new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(self.cache_path)

    def count(self, docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
        """Adds out_col to every row (with underscores behind it where the frame has that column already); a null text counts as empty (0 tokens), repeated rows stay repeated."""
        self.encode_misses(docs, text_col)
        key = fresh(docs, "content")
        keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
        n = fresh(keyed, out_col)
        counts = self.known().select(F.col("content").alias(key), F.col("n_tokens").alias(n))
        return keyed.join(counts, key, "left").withColumn(n, counted(n)).drop(key)


def counted(n: str) -> Column:
    """The count, or an error where a content has none."""
    return F.when(F.col(n).isNull(), F.raise_error(F.lit("a content has no token count"))).otherwise(F.col(n)).cast("long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cache = TokenCounts(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    cache.encode_misses(docs)
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("content"))
    got = narrow.join(cache.known(), "content", "left").withColumn("n_tokens", counted("n_tokens"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
