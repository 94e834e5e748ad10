"""Secret scans with corpus-wide ownership frequency.

Candidates are found text by text: assigned values, access keys, long hex runs, and other tokens of 16
characters or more that hold a digit and vary enough. Each candidate's SHA-256 is counted over the
whole corpus by distinct repositories and distinct owners. A value that many owners hold is a copied
example; one that few owners hold looks live. The first three kinds are always reported, with their
counts; a plain token is a span of its own only as long as few owners hold it.
Only hashes, ids and places are shuffled, never texts. Counts are written out before they are joined,
so that Spark can split a value that very many documents hold.

In the registered query a document is a repository and its source is the owner.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, ship, written

ship(__name__)

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def scan(text: str | None, min_entropy: float = 2.5) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by start, then kind; tokens only where no other kind's span is touched."""
    if not text:
        return []
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            found.append((m.start(), m.end(), "assign", m[2]))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(m.start(), m.end(), kind, m[0]) for m in pattern.finditer(text)]
    taken = sorted((s, e) for s, e, *_ in found)
    k = reach = 0
    for m in TOKEN.finditer(text):
        v = m[0]
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach > m.start():
            continue
        if any(c.isdigit() for c in v) and entropy(v) >= min_entropy:
            found.append((m.start(), m.end(), "token", v))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("digest", pa.binary())]))


def _spans(texts: pa.Array) -> pa.Array:
    return pa.array([[{"start": s, "end": e, "kind": k, "digest": hashlib.sha256(v.encode()).digest()} for s, e, k, v in scan(t)] for t in texts.to_pylist()], SPAN)


def candidates(docs: DataFrame, text_col: str = "text", out_col: str = "found") -> DataFrame:
    """Adds the candidates of each text as an array of (start, end, kind, digest); places count code points."""
    return docs.withColumn(out_col, F.arrow_udf(_spans, "array<struct<start:long,end:long,kind:string,digest:binary>>")(F.col(text_col)))


def ownership(found: DataFrame, repo_col: str, owner_col: str) -> DataFrame:
    """digest, repositories, owners, uses: over all candidates of the corpus. A null repository or owner counts as one of its own."""
    each = found.select(F.explode("found.digest").alias("digest"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"))
    by_repo = each.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.sum("repos").alias("repositories"), F.count("*").alias("owners"), F.sum("n").alias("uses"))


def scan_secrets(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", max_owners: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: repo_col, owner_col, the kept columns as they are, and `secrets`, an array of
    (start, end, kind, digest, repositories, owners, live) by start, then kind.

    live: at most max_owners owners hold the value. Plain tokens that aren't live are left out. Null and
    empty texts have no secrets; repeated rows each get a row, and count as one repository if their
    repository is the same. A column named secrets that is to be kept is an error."""
    names = list(dict.fromkeys((repo_col, owner_col, *keep)))
    if "secrets" in {c.lower() for c in names}:
        raise ValueError("the result has a column secrets of its own")
    rows = docs.select(F.struct(*names).alias("kept"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.col(text_col).alias("text"))
    rows = written(candidates(rows, "text", "found").drop("text").withColumn("uid", F.monotonically_increasing_id()), "secret-candidates")
    owned = written(ownership(rows, "repo", "owner"), "secret-owners")
    spans = rows.select("uid", F.explode("found").alias("f")).select("uid", "f.*").join(owned, "digest")
    spans = spans.withColumn("live", F.col("owners") <= max_owners).where((F.col("kind") != KINDS[-1]) | F.col("live"))
    order = F.when(F.col("kind") == KINDS[0], 0)
    for i, k in enumerate(KINDS[1:], 1):
        order = order.when(F.col("kind") == k, i)
    spans = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("rank"), "end", "kind", "digest", "repositories", "owners", "live"))).alias("secrets"))
    empty = F.array().cast(spans.schema["secrets"].dataType)
    return rows.join(spans, "uid", "left").select("kept.*", F.coalesce("secrets", empty).alias("secrets"))


def redact(texts, spans) -> list:
    """Each text with its spans replaced by a mark of the kind; overlapping spans become one."""
    out = []
    for text, every in zip(texts, spans):
        if text is None or not every:
            out.append(text)
            continue
        parts, at = [], 0
        for s in every:
            if s["end"] <= at:
                continue
            if s["start"] >= at:
                parts += [text[at : s["start"]], f"[{'redacted' if s['live'] else 'example'} {s['kind']}]"]
            at = s["end"]
        out.append("".join([*parts, text[at:]]))
    return out


def redact_secrets(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", max_owners: int = 2) -> DataFrame:
    """The documents, all columns as they were, with every candidate in the text replaced by [redacted kind], or [example kind] if many owners hold it.
    Plain tokens that many owners hold stay.

    Each text is searched once, when the documents are written with their candidates. Texts without candidates are
    passed on in place; the others' digests are looked up in the written table of those that many owners hold."""
    uid, found, marks = fresh(docs, "uid"), fresh(docs, "found"), fresh(docs, "marks")
    hit = written(candidates(docs, text_col, found).withColumn(uid, F.monotonically_increasing_id()), "secret-texts")
    some = hit.where(F.size(found) > 0)
    owned = ownership(some.select(F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.col(found).alias("found")), "repo", "owner")
    copied = written(owned.where(F.col("owners") > max_owners).select("digest", F.lit(True).alias("many")), "secret-copied")
    each = some.select(uid, F.explode(found).alias("f")).select(uid, "f.*").join(copied, "digest", "left").where((F.col("kind") != KINDS[-1]) | F.col("many").isNull())
    listed = each.groupBy(uid).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", F.col("many").isNull().alias("live")))).alias(marks))
    cut = F.arrow_udf(lambda t, s: pa.array(redact(t.to_pylist(), s.to_pylist()), pa.string()), "string")
    fixed = some.join(listed, uid, "left").withColumn(text_col, cut(F.col(text_col), F.col(marks)))
    return hit.where(F.size(found) == 0).select(*docs.columns).unionByName(fixed.select(*docs.columns))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    got = scan_secrets(docs)
    base = F.filter("secrets", lambda s: s.kind != "token")
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    size = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    return got.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text("secrets").alias("spans"), F.size(F.filter("secrets", lambda s: s.live)).cast("long").alias("n_live"))
