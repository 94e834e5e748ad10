"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q and a length of at least max(least, 2 q) that can't be made
longer. At scale B = 2, 4, 8, ... every text is cut into blocks of B words, and one convolution of each block with
the words behind it gives the sums of squared differences at all distances from 2 B - 1 to 4 B - 2 (from 1 at the
lowest scale). A sum of zero is an occurrence. Sums are exact: number-theoretic transforms modulo two primes
whose product exceeds any of them. A run of period q holds, before its last q words, a whole block of the scale
to which q belongs, so none is missed. Neighbouring blocks with an occurrence at the same distance are one seed, which is
extended to both sides by comparing words.

Two kinds of blocks need no convolution: those with a word that doesn't come again within the largest distance, and
those that lie, with all that follows up to that distance, in a run found before of at most half a block's period.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, fresh, ship, utf8

ship(__name__)

PRIMES = ((2013265921, 31), (1811939329, 13))  # k * 2**26 + 1 or more, with a generator of all residues
CELLS = 1 << 20  # numbers in one transform of many blocks
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def powers(p: int, root: int, n: int) -> np.ndarray:
    """root to the powers 0 to n-1 modulo p."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, root
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step) % np.uint64(p)
        step, done = step * step % p, done + more
    return out


class Transform:
    """Cyclic convolutions of n (a power of two) numbers modulo a prime, for many columns at once.

    Forward results stay in the order in which halving leaves them; backward takes them so."""

    def __init__(self, n: int, prime: int, generator: int):
        root = pow(generator, (prime - 1) // n, prime)
        self.n, self.p = n, np.uint64(prime)
        self.down = powers(prime, root, n // 2)
        self.up = powers(prime, pow(root, -1, prime), n // 2)
        self.scale = np.uint64(pow(n, -1, prime))

    def forward(self, a: np.ndarray) -> np.ndarray:
        p, half = self.p, self.n // 2
        while half:
            x = a.reshape(-1, 2, half, a.shape[1])
            u, v = x[:, 0], x[:, 1]
            out = np.empty_like(x)
            np.add(u, v, out=out[:, 0])
            np.minimum(out[:, 0], out[:, 0] - p, out=out[:, 0])  # unsigned: a difference below 0 is large
            out[:, 1] = (u + (p - v)) * self.down[:: self.n // 2 // half][:half, None] % p
            a, half = out.reshape(a.shape), half // 2
        return a

    def backward(self, a: np.ndarray) -> np.ndarray:
        p, half = self.p, 1
        while half < self.n:
            x = a.reshape(-1, 2, half, a.shape[1])
            u, v = x[:, 0], x[:, 1] * self.up[:: self.n // 2 // half][:half, None] % p
            out = np.empty_like(x)
            np.add(u, v, out=out[:, 0])
            np.minimum(out[:, 0], out[:, 0] - p, out=out[:, 0])
            np.add(u, p - v, out=out[:, 1])
            np.minimum(out[:, 1], out[:, 1] - p, out=out[:, 1])
            a, half = out.reshape(a.shape), half * 2
        return a * self.scale % p


def occurrences(block: np.ndarray, window: np.ndarray, transforms: list[Transform]) -> np.ndarray:
    """Where each block occurs in its window: block (B, m), window (at least B, m) of small non-negative numbers; result (window - B + 1, m)."""
    size, n = len(block), transforms[0].n
    places = len(window) - size + 1
    sums = np.zeros((len(window) + 1, window.shape[1]), np.int64)
    np.cumsum(window * window, axis=0, out=sums[1:])
    squares = (block * block).sum(0) + sums[size : size + places] - sums[:places]
    found = np.ones((places, block.shape[1]), bool)
    for t in transforms:
        a = np.zeros((2, n, block.shape[1]), np.uint64)
        a[0, :size], a[1, : len(window)] = block[::-1], window
        a %= t.p
        product = t.backward(t.forward(a[0]) * t.forward(a[1]) % t.p)[size - 1 : size - 1 + places].astype(np.int64)
        found &= (squares - 2 * product) % int(t.p) == 0
        if not found.any():
            break
    return found


def longest_gap(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Distance from each word to its next occurrence in the same text; very large without one."""
    gap = np.full(len(ids), len(ids) + 1, np.int64)
    order = np.lexsort((ids, of))
    same = (ids[order][1:] == ids[order][:-1]) & (of[order][1:] == of[order][:-1])
    gap[order[:-1][same]] = np.diff(order)[same]
    return gap


def stretched(ids: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, end: np.ndarray, d: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Extends stretches [begin, end) of words that equal those d further on, as far as texts [low, high) go."""
    begin, end = begin.copy(), end.copy()
    at = np.arange(step)
    chunk = max(1, CELLS // step)
    for forward in (True, False):
        live = np.arange(len(d))
        while len(live):
            more = []
            for i in range(0, len(live), chunk):
                k = live[i : i + chunk]
                place = end[k, None] + at if forward else begin[k, None] - 1 - at
                inside = place + d[k, None] < high[k, None] if forward else place >= low[k, None]
                place = np.where(inside, place, low[k, None])
                equal = inside & (ids[place] == ids[np.minimum(place + d[k, None], len(ids) - 1)])
                n = np.where(equal.all(1), step, equal.argmin(1))
                if forward:
                    end[k] += n
                else:
                    begin[k] -= n
                more.append(k[n == step])
            live = np.concatenate(more)
    return begin, end


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of all texts, starts and ends counted over all ids; text k has ids[first[k]:first[k + 1]]. In order of start, then period."""
    assert least >= 5  # the lowest scale looks for two words again at distances from 1 on
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    gap = longest_gap(ids, of)  # of the words of a block of the scale, from its first word
    wide = int(ids.max(initial=0)) + 1  # stands for what lies behind the text
    none = np.zeros(0, np.int64)
    start = stop = period = none
    size = 2
    while len(n) and 2 * size - 1 <= max(1, n.max() // 2) or size == 2:
        near, far = (1 if size == 2 else 2 * size - 1), 4 * size - 2
        shifted = np.full(len(gap), len(ids) + 1, np.int64)
        shifted[: len(gap) - size // 2] = gap[size // 2 :]
        gap = np.maximum(gap, shifted)
        many = n // size
        text = np.repeat(np.arange(len(n)), many)
        b = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * size
        keep = gap[b] <= far
        b, text = b[keep], text[keep]
        # blocks in known runs: at most one run of half a block's period or less can hold a block
        old = np.flatnonzero((2 * period <= size) & (stop - start >= size))
        old = old[np.argsort(start[old])]

        def held(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(old):
                return np.zeros(len(b), bool), np.zeros(len(b), np.int64)
            k = np.searchsorted(start[old], b, "right") - 1
            k = old[np.maximum(k, 0)]
            return (b >= start[k]) & (b + size <= stop[k]), k  # noqa: B023

        inside, k = held(b)
        if len(old):
            keep = ~(inside & (b + far + size <= stop[k]))
            b, text = b[keep], text[keep]
        transforms = [Transform(4 * size, *x) for x in PRIMES[: 1 if (wide + 1) ** 2 * size < PRIMES[0][0] else 2]]
        seeds_b, seeds_d = [], []
        chunk = max(1, CELLS // (4 * size))
        for i in range(0, len(b), chunk):
            at, end = b[i : i + chunk], first[text[i : i + chunk] + 1]
            places = at + near + np.arange(far - near + size)[:, None]
            window = np.where(places < end, ids[np.minimum(places, len(ids) - 1)], wide)
            d, col = np.nonzero(occurrences(ids[at + np.arange(size)[:, None]], window, transforms))
            seeds_b.append(at[col])
            seeds_d.append(d + near)
        sb, sd = (np.concatenate(x) if x else none for x in (seeds_b, seeds_d))
        inside, k = held(sb)
        if len(old):
            keep = ~(inside & (sb + sd + size <= stop[k]) & (sd % np.maximum(period[k], 1) == 0))  # would give that run again
            sb, sd = sb[keep], sd[keep]
        if len(sb):
            order = np.lexsort((sb, sd))
            sb, sd = sb[order], sd[order]
            head = np.flatnonzero(np.concatenate(([True], (sd[1:] != sd[:-1]) | (sb[1:] != sb[:-1] + size) | (of[sb[1:]] != of[sb[:-1]]))))
            tail = np.concatenate((head[1:], [len(sb)])) - 1
            begin, end, d = sb[head], sb[tail] + size, sd[head]
            begin, end = stretched(ids, first[of[begin]], first[of[begin] + 1], begin, end, d, size)
            long = end + d - begin >= np.maximum(least, 2 * d)
            start, stop, period = (np.concatenate(x) for x in ((start, begin[long]), (stop, (end + d)[long]), (period, d[long])))
            order = np.lexsort((period, stop, start))
            start, stop, period = start[order], stop[order], period[order]
            # a longer distance over the same stretch is a multiple of its smallest period
            keep = np.concatenate(([True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])))[: len(start)]
            start, stop, period = start[keep], stop[keep], period[keep]
        size *= 2
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the words, counted anew in each text, and where each text begins (and the last ends)."""
    parts = [np.fromiter(map(defaultdict(count().__next__).__getitem__, w), np.int64, len(w)) for w in texts]
    return np.concatenate(parts or [np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64)


def found(least: int, most_bytes: int = 2_000_000):
    """An Arrow function from texts to their runs and what is left once repetitions have gone."""

    def run(texts: pa.Array) -> pa.Array:
        out_runs, kept = [], []
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        for i, j in blocks(sizes, most_bytes):
            words = [t.split() for t in utf8(texts.slice(i, j - i))]
            ids, first = word_ids(words)
            start, stop, period = runs_of(ids, first, least)
            drop = np.zeros(len(ids) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, stop, -1)
            keep = np.cumsum(drop)[:-1] == 0
            cut = np.searchsorted(start, first)
            for k, w in enumerate(words):
                x = slice(cut[k], cut[k + 1])
                out_runs.append([{"start": s, "length": n, "period": q} for s, n, q in zip((start[x] - first[k]).tolist(), (stop[x] - start[x]).tolist(), period[x].tolist())])
                own = keep[first[k] : first[k + 1]]
                kept.append(b" ".join(w if own.all() else [w[z] for z in np.flatnonzero(own).tolist()]).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(out_runs, kind), pa.array(kept, pa.string())], ["runs", "collapsed"])

    return F.arrow_udf(run, f"runs {RUNS}, collapsed string")


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """Adds `runs`, an array of (start, length, period) in words, by start and then period, and `collapsed`, the words
    that no run holds behind its first period, joined by one space. All rows and columns stay.

    Words are what white space of ASCII parts. Null and empty texts have no runs and an empty rest. Repeated rows are
    worked on each; columns that have these names already keep them, and the new ones get underscores behind theirs. An empty table
    gives an empty one. Texts stay in their tasks: nothing is shuffled."""
    both, runs, rest = fresh(docs, "found"), fresh(docs, "runs"), fresh(docs, "collapsed")
    out = docs.withColumn(both, found(least)(F.col(text_col)))
    return out.select(*docs.columns, F.col(f"{both}.runs").alias(runs), F.col(f"{both}.collapsed").alias(rest))


def planted(ids: Column, texts: Column) -> Column:
    """The texts with a repetition put into one in ten: of h, the crc32 of the id, h % 10 = 0 chooses the text, and h // 10 where it begins and how long a period is."""

    def run(h: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for x, t in zip(h.to_pylist(), texts.to_pylist()):
            w = t.encode().split() if t and x % 10 == 0 else []
            if w:
                g, n = x // 10, len(w)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                t = b" ".join(w[:a] + [w[a + (i - a) % p] for i in range(a, n)]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")), texts)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    got = periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    got = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return got.select(
        "doc_id",
        "n_runs",
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
