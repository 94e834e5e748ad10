"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: each bit of the XXH64 of a text's shingles votes; a bit is set if over half have it.
Equal fingerprints are one row from there on, so copies cost nothing.

Index: two fingerprints that differ in at most `distance` bits agree in full on one of
distance + 1 blocks of bits, so rows are dealt by (block, its value). A bucket of more than
`bucket_rows` is dealt again by blocks of its remaining bits, as often as needed; no pair is lost and
no bucket grows with the input. In a bucket the fingerprints are sorted by Gray rank and every
`fan` neighbours form a node that holds the bits on which they all agree; nodes of nodes hold what
their children share and the children only what is new. A query adds up differences from the top
and drops a node with all below it once they pass the distance.

A bucket reports links of a spanning forest of the pairs it found, not all pairs.

`later_copies` decides by the texts themselves. Fingerprints of two-word shingles, which move less
under edits, only propose: they are merged where equal, then linked within a wider distance (a bucket reports a
spanning forest of smallest differences), and what links reach is a family. A link of two texts needs a Jaccard similarity of
their five-word shingles of `least` or more. Checked are the links themselves, and neighbours in the family's order by
smallest shingle hashes, first by two such orders, then, between texts that are still apart, by more: the
number of checks follows that of the texts, however many share a fingerprint or fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import neighbours
from .common import U64, mix, ship, written
from .components import components

ship(__name__)

BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
OFFSET = np.arange(8) * 256


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, repeats counted; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    data = b" ".join(words)
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    k = min(size, len(words))
    starts = (ends - n)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[i:j], seed) for i, j in zip(starts, ends[k - 1 :].tolist())], U64)
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + OFFSET).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(h), bitorder="little").tobytes(), "little")


def fingerprints(size: int = 4, seed: int = 42):
    """An Arrow function from texts to fingerprints as signed 64-bit numbers."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, size, seed) for t in texts.to_pylist()], U64).view(np.int64))

    return F.arrow_udf(run, "long")


def split_mask(pinned: int, parts: int) -> list[int]:
    """The bits that are not pinned, in `parts` nearly equal blocks; each result pins one block more."""
    free = [b for b in range(64) if not pinned >> b & 1]
    cut = [len(free) * k // parts for k in range(parts + 1)]
    return [pinned | sum(1 << b for b in free[x:y]) for x, y in zip(cut, cut[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer_masks(parts: int):
    def run(masks: pa.Array) -> pa.Array:
        return pa.array([[signed(x) for x in split_mask(m % 2**64, parts)] for m in masks.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U64(s))
    return x


class GrayIndex:
    """Nodes over codes that are sorted by (bucket, Gray rank). begin: where each bucket begins, and the end."""

    def __init__(self, codes: np.ndarray, begin: np.ndarray, fan: int = 8):
        self.codes, self.fan = codes, fan
        self.levels = []  # from the lowest: first child, end of children, shared bits, their values, new bits
        lo, hi = codes, codes
        inner = begin
        while True:
            size = np.diff(inner)
            nodes = -(-size // fan)
            at = np.concatenate(([0], np.cumsum(nodes)))
            bucket = np.repeat(np.arange(len(size)), nodes)
            first = inner[bucket] + (np.arange(at[-1]) - at[bucket]) * fan
            last = np.minimum(first + fan, inner[bucket + 1])
            lo, hi = np.bitwise_and.reduceat(lo, first), np.bitwise_or.reduceat(hi, first)
            shared = ~(lo ^ hi)
            self.levels.append([first, last, shared, lo, shared.copy()])
            inner = at
            if nodes.max(initial=0) <= 1:
                break
        for upper, lower in zip(self.levels[1:], self.levels):
            parent = np.repeat(np.arange(len(upper[0])), upper[1] - upper[0])
            lower[4] = lower[2] & ~upper[2][parent]

    def search(self, query: np.ndarray, code: np.ndarray, bucket: np.ndarray, most: int):
        """(query, member, difference) of pairs within the distance, member behind the query in the order; each bucket has one root."""
        node, acc = bucket, np.zeros(len(query), np.int64)
        for first, last, _, value, new in reversed(self.levels):
            acc = acc + np.bitwise_count((code ^ value[node]) & new[node])
            keep = acc <= most
            query, code, node, acc = query[keep], code[keep], node[keep], acc[keep]
            n = last[node] - first[node]
            child = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            leaf_shared = self.levels[0][2][node] if first is self.levels[0][0] else None
            query, code, acc = np.repeat(query, n), np.repeat(code, n), np.repeat(acc, n)
            if leaf_shared is not None:
                behind = child > query
                query, child, acc = query[behind], child[behind], acc[behind]
                far = acc + np.bitwise_count((code[behind] ^ self.codes[child]) & ~np.repeat(leaf_shared, n)[behind])
                near = far <= most
                return query[near], child[near], far[near]
            node = child
        raise AssertionError


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Lowest index of each item's component under all the pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                down = label[label]
                if (down == label).all():
                    break
                label = down
    return label


def closest_forest(n: int, chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of smallest differences of all the pairs (Boruvka), keeping one forest at a time."""
    a, b, d = (np.zeros(0, np.int64) for _ in range(3))
    for more in chunks:
        if not len(more[0]):
            continue
        a, b, d = (np.concatenate(x) for x in zip((a, b, d), more))
        order = np.argsort(d, kind="stable")
        a, b, d = a[order], b[order], d[order]
        label, chosen, live = np.arange(n), np.zeros(len(a), bool), np.arange(len(a))
        while True:
            x, y = label[a[live]], label[b[live]]
            apart = x != y
            live, x, y = live[apart], x[apart], y[apart]
            if not len(live):
                break
            best = np.full(n, len(a))
            np.minimum.at(best, x, live)
            np.minimum.at(best, y, live)
            pick = np.unique(best[best < len(a)])
            chosen[pick] = True
            label = forest(n, iter([(a[chosen], b[chosen])]))
        a, b, d = a[chosen], b[chosen], d[chosen]
    return a, b


def bucket_links(distance: int, fan: int, closest: bool, frontier: int = 1_000_000):
    """Links of a spanning forest in each bucket; rows (mask, value, code) come sorted by bucket and Gray rank."""

    def links(codes: np.ndarray, key: np.ndarray):
        begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True])))
        size = np.diff(begin)
        index = GrayIndex(codes, begin, fan)
        bucket = np.repeat(np.arange(len(size)), size)

        def pairs():
            work = np.cumsum(size[bucket])
            i = 0
            while i < len(codes):
                j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + frontier)))
                yield index.search(np.arange(i, min(j, len(codes))), codes[i:j], bucket[i:j], distance)
                i = j

        if closest:
            a, b = closest_forest(len(codes), pairs())
        else:
            label = forest(len(codes), (p[:2] for p in pairs()))
            a = np.flatnonzero(label != np.arange(len(codes)))
            b = label[a]
        return pa.RecordBatch.from_pydict({"a": pa.array(codes[a].view(np.int64)), "b": pa.array(codes[b].view(np.int64))})

    def run(batches):
        codes, key = np.zeros(0, U64), np.zeros((0, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.concatenate((codes, batch.column(2).to_numpy().view(U64)))
            key = np.concatenate((key, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)))
            cut = np.flatnonzero((key != key[-1]).any(1))
            cut = int(cut[-1]) + 1 if len(cut) else 0  # the last bucket may go on
            if cut:
                yield links(codes[:cut], key[:cut])
                codes, key = codes[cut:], key[cut:]
        if len(codes):
            yield links(codes, key)

    return run


def link_fingerprints(distinct: DataFrame, col: str, distance: int = 4, bucket_rows: int = 20_000, fan: int = 8, closest: bool = False) -> DataFrame:
    """(a, b): links that join all fingerprints that chains of differences up to the distance join. Input: distinct non-null 64-bit numbers.

    closest: a bucket's links are those of smallest differences. A bucket that is dealt again is copied distance + 1 times."""
    code = F.col(col).alias("code")
    masks = split_mask(0, distance + 1)
    rows = distinct.select(code, F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in masks])).alias("mask"))
    rows = written(rows.select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("value"), "code"), "sim-buckets")
    parts = []
    while True:
        # buckets with at most `distance` free bits have 2**distance different fingerprints at most
        large = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where((F.col("n") > bucket_rows) & (F.bit_count("mask") < 64 - distance))
        large = written(large.select("mask", "value"), "sim-large")
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(large, ["mask", "value"], "left_anti"))
        rows = rows.join(large, ["mask", "value"], "left_semi").select("code", F.explode(finer_masks(distance + 1)(F.col("mask"))).alias("mask"))
        rows = written(rows.select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("value"), "code").distinct(), "sim-buckets")
    out = None
    gray = F.col("code")
    for s in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, s))
    for p in parts:
        spread = p.withColumn("gray", gray).repartition("mask", "value").sortWithinPartitions("mask", "value", "gray")
        found = spread.select("mask", "value", "code").mapInArrow(bucket_links(distance, fan, closest), "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out


def with_roots(kinds: DataFrame, distance: int = 4, bucket_rows: int = 20_000) -> DataFrame:
    """Adds root to a written table of distinct fingerprints fp: one fingerprint of the component, and of no other."""
    roots = components(link_fingerprints(kinds, "fp", distance, bucket_rows), "a", "b")
    return kinds.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42, distance: int = 4, bucket_rows: int = 20_000) -> DataFrame:
    """(id, fingerprint as signed long, component, root): component is the lowest id that links reach.

    Texts without words (null, empty) have fingerprint 0 and are linked like any other. Repeated
    rows each get a row. A null id gets a row and never names a component, unless all its ids are null.
    So components share a name where ids are null or repeated; root, a fingerprint, tells them apart.
    An empty table gives no rows. Other columns are left out, so their names can't clash."""
    rows = docs.select(F.col(id_col).alias("id"), fingerprints(size, seed)(F.col(text_col)).alias("fp"))
    rows = written(rows, "sim-fingerprints")
    kinds = written(rows.groupBy("fp").agg(F.min("id").alias("lowest")), "sim-kinds")
    linked = with_roots(kinds, distance, bucket_rows)
    best = linked.groupBy("root").agg(F.min("lowest").alias("component"))
    named = written(linked.join(best, "root").select("fp", "component", "root"), "sim-components")
    return rows.join(named, "fp").select("id", F.col("fp").alias("fingerprint"), "component", "root")


def word_digest(text: str | None) -> bytes:
    """128 bits of the text's words: equal for texts that differ in case and white space alone."""
    return xxhash.xxh128_digest(b" ".join(text.encode().lower().split()) if text else b"")


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of the different word shingles; fewer words are one shingle, none give none."""
    words = text.encode().lower().split() if text else []
    k = min(size, len(words))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 7) for i in range(len(words) - k + 1)] if words else [], U64)).view(np.int64)


LOOKS = 8  # smallest shingle hashes of a text, each under a mixing of its own


def smallest(hashes: np.ndarray) -> list[int]:
    h = hashes.view(U64)
    return [int(mix(h ^ U64(k * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64).min()) if len(h) else 0 for k in range(LOOKS)]


def proposed(members: DataFrame, looks: range, labels: DataFrame | None) -> DataFrame:
    """(a, b): nodes that are neighbours among those of a family with the same smallest hash, in order of another such hash; with labels (node, root), of different roots only.

    Chains, not pairs: at most one link for each node and look."""
    look = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.get("least", F.lit(k)).alias("h"), F.get("least", F.lit((k + 1) % LOOKS)).alias("tie")) for k in looks]))
    rows = members.select("family", "node", look.alias("x")).select("family", "node", "x.*")
    order = [F.col("tie"), F.col("node")]
    if labels is not None:
        rows = rows.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = rows.groupBy("family", "k", "h", "root").agg(F.min(F.struct("tie", "node")).alias("x")).select("family", "k", "h", "x.tie", "x.node")
    links = neighbours(rows, ["family", "k", "h"], order, ["node"], around=False).where("next_node is not null")
    return links.select(F.least("node", "next_node").alias("a"), F.greatest("node", "next_node").alias("b")).distinct()


def later_copies(rows: DataFrame, uid: str, text_col: str = "text", order: tuple[str, ...] = (), least: float = 0.8, size: int = 5, index_size: int = 2, distance: int = 9, bucket_rows: int = 20_000) -> DataFrame:
    """A written table of the uids that are not the first of their group, by the order columns (nulls last) and then uid.

    rows: a written table in which uid tells rows apart. Groups are chains of texts of equal words and of
    links with a Jaccard similarity of at least `least` of their `size`-word shingles. Null and empty texts have
    equal words. Texts are read where they lie; fingerprints, digests and the shingles of texts in families are shuffled."""

    def prints(texts: pa.Array) -> pa.Array:
        every = texts.to_pylist()
        fp = pa.array(np.array([fingerprint(t, index_size) for t in every], U64).view(np.int64))
        return pa.StructArray.from_arrays([fp, pa.array([word_digest(t) for t in every], pa.binary())], ["fp", "digest"])

    def sets(texts: pa.Array) -> pa.Array:
        every = [shingles(t, size) for t in texts.to_pylist()]
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(every, kind), pa.array([smallest(x) for x in every], kind)], ["s", "least"])

    own = rows.select(F.col(uid).alias("uid"), F.struct(*[x for k, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{k}"), F.col(c).alias(f"c{k}"))], F.col(uid).alias("uid")).alias("place"), F.arrow_udf(prints, "fp long, digest binary")(F.col(text_col)).alias("p"))
    own = written(own.select("uid", "place", "p.fp", "p.digest"), "sim-prints")
    kinds = written(own.groupBy("digest").agg(F.min("place").alias("place"), F.first("fp").alias("fp")).select(F.col("place.uid").alias("node"), "place", "fp"), "sim-kinds")
    codes = written(kinds.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "sim-codes")
    near = written(link_fingerprints(codes.select("fp"), "fp", distance, bucket_rows, closest=True).distinct(), "sim-proposed")
    family = codes.join(components(near, "a", "b").withColumnRenamed("node", "fp"), "fp", "left").where("root is not null or n > 1").select("fp", F.coalesce("root", "fp").alias("family"))
    member = written(kinds.select("node", "fp").join(family, "fp").select(F.col("node").alias(uid), "family"), "sim-members")
    found = rows.select(uid, text_col).join(member, uid).select(F.col(uid).alias("node"), "family", F.arrow_udf(sets, "s array<long>, least array<long>")(F.col(text_col)).alias("x"))
    found = written(found.select("node", "family", "x.*"), "sim-shingles")
    sets_of = lambda end: found.select(F.col("node").alias(end), F.col("s").alias(f"s{end}"))

    def alike(pairs: DataFrame) -> DataFrame:
        common = F.size(F.array_intersect("sa", "sb"))
        return written(pairs.join(sets_of("a"), "a").join(sets_of("b"), "b").where(common >= least * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "sim-alike")

    node_of = lambda end: codes.select(F.col("fp").alias(end), F.col("node").alias(f"n{end}"))
    between = near.join(node_of("a"), "a").join(node_of("b"), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    links = alike(between.unionByName(proposed(found, range(2), None)).distinct())
    links = links.unionByName(alike(proposed(found, range(2, LOOKS), components(links, "a", "b"))))
    roots = components(links, "a", "b")
    first = kinds.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("place").alias("place"))
    return written(own.select("uid").join(first.select(F.col("place.uid").alias("uid")), "uid", "left_anti").select(F.col("uid").alias(uid)), "sim-later")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = near_duplicates(docs)
    return got.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
