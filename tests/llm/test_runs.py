import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm.runs import PRIMES, Transform, occurrences, op11_periodic_runs, periodic_runs, runs_of, word_ids

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=12):
    """Every period by itself: stretches of words that equal those q further on."""
    got = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                got.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in got.items())


def fast_runs(texts, least=12):
    ids, first = word_ids(texts)
    start, stop, period = runs_of(ids, first, least)
    out = [[] for _ in texts]
    for s, e, q in zip(start.tolist(), stop.tolist(), period.tolist()):
        k = int(np.searchsorted(first, s, "right")) - 1
        while first[k + 1] <= s:
            k += 1
        out[k].append((s - int(first[k]), e - s, q))
    return out


@pytest.mark.parametrize("prime, generator", PRIMES)
def test_transform_against_a_plain_convolution(prime, generator):
    rng = np.random.default_rng(1)
    for n in (2, 8, 64):
        t = Transform(n, prime, generator)
        a, b = rng.integers(0, prime, (2, n, 3)).astype(np.uint64)
        got = t.backward(t.forward(a) * t.forward(b) % t.p)
        for c in range(3):
            want = [sum(int(a[i, c]) * int(b[(k - i) % n, c]) for i in range(n)) % prime for k in range(n)]
            assert got[:, c].tolist() == want


def test_occurrences_with_numbers_beyond_one_prime():
    rng = np.random.default_rng(2)
    block = rng.integers(0, 1 << 20, (4, 50))
    window = rng.integers(0, 1 << 20, (11, 50))
    for c in range(0, 50, 2):
        window[c % 8 : c % 8 + 4, c] = block[:, c]
    got = occurrences(block, window, [Transform(16, *x) for x in PRIMES])
    want = np.array([[(window[d : d + 4, c] == block[:, c]).all() for c in range(50)] for d in range(8)])
    assert (got == want).all() and want.sum() >= 25


def texts_like(rng):
    kind, n = rng.randrange(6), rng.randrange(0, 260)
    few = [b"a", b"b", b"c"][: rng.randrange(1, 4)]
    if kind == 0:
        return [rng.choice(few) for _ in range(n)]
    if kind == 1:
        return [b"%d" % rng.randrange(1000) for _ in range(n)]
    if kind == 2:
        unit = [b"%d" % rng.randrange(50) for _ in range(rng.randrange(1, 60))]
        return [b"x", b"y"][: rng.randrange(3)] + (unit * 300)[:n] + unit[: rng.randrange(5)]
    if kind == 3:
        inner = [rng.choice(few)] * 13 + [b"%d" % rng.randrange(9)] * rng.randrange(4)
        return (inner * 40)[:n] + [b"z"] * rng.randrange(20)
    if kind == 4:
        a, b = [b"a"], [b"a", b"b"]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    return (texts_like(rng) + texts_like(rng)) * rng.randrange(1, 4)


def test_runs_against_every_period():
    rng = random.Random(5)
    texts = [texts_like(rng) for _ in range(240)]
    for k in range(0, 240, 20):
        assert fast_runs(texts[k : k + 20]) == [plain_runs(w) for w in texts[k : k + 20]]
    assert fast_runs(texts[:60], 5) == [plain_runs(w, 5) for w in texts[:60]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=70), max_size=4))
def test_runs_of_two_words(texts):
    assert fast_runs(texts) == [plain_runs(w) for w in texts]


def test_long_repetitions_end_soon():
    w = [b"a", b"b", b"c", b"d"] * 30_000
    assert fast_runs([w, [b"a"] * 50_001, w[1:-1]]) == [[(0, 120_000, 4)], [(0, 50_001, 1)], [(0, 119_998, 4)]]
    unit = [b"%d" % i for i in range(7_001)]
    assert fast_runs([[b"x"] * 30 + unit * 3 + [b"y"]]) == [[(0, 30, 1), (30, 21_003, 7_001)]]


def test_query_against_every_period(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    repeated = 0
    for r in got:
        w, h = docs[r.doc_id].encode().split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 3000:
            continue  # the plain way takes the square of the length
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest()
        repeated += bool(runs)
    assert repeated >= 15


def test_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.selectExpr("*", "7 AS runs", "8 AS collapsed", "9 AS found")
    got = periodic_runs(df)
    assert got.columns == [*df.columns, "runs_", "collapsed_"]
    rows = got.collect()
    assert len(rows) == df.count()
    for r in rows:
        w = (r.text or "").encode().split()
        if len(w) < 1000:
            assert [tuple(x) for x in r.runs_] == plain_runs(w)
        else:
            assert [tuple(x) for x in r.runs_] == [(0, len(w), 4)] and r.collapsed_ == "alpha beta gamma delta"
    assert {r.collapsed_ for r in rows if not (r.text or "").strip()} == {""}
    assert periodic_runs(no_docs).count() == 0
