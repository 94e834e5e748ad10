"""A training-corpus pipeline: each stage takes the documents that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the frame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import fresh, written
from geoloom.llm.decontam import Decontaminator
from geoloom.llm.packing import pack
from geoloom.llm.secrets import redact_secrets
from geoloom.llm.simhash import later_copies
from geoloom.llm.toxicity import ToxicityModel

TOXIC_FROM = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM, by a model of the labelled ones among them.

    Null and empty texts get the score of the constant feature; repeated rows are judged alike and all stay or go.
    Other columns, of whatever name, stay as they are; an empty table gives an empty one."""
    model = ToxicityModel().fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return model.score(docs, out_col=score).where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): that with the lowest doc_id, null last; of repeated ids any one.

    Null and empty texts are copies of each other. Rows are told apart by a number of their own, so ids may be null or repeated."""
    uid = fresh(docs, "row_uid")
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "dedup-rows")
    # where few documents go, Spark sends their numbers to the others, which then stay where they are
    return rows.join(later_copies(rows, uid, "text", ("doc_id",)), uid, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts stay; rows of null or repeated ids are judged one by one."""
    return Decontaminator().clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by marks; n_chars counts the new text (null for a null text).

    Repeated rows stay; a null doc_id or source counts as one repository or owner."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 2048. A null or empty text is one piece of the end id; repeated rows are packed each. Other columns are left out."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: A trained model, fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
