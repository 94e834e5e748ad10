import numpy as np
import pytest
import xxhash

from geoloom.llm.components import components
from geoloom.llm.common import written
from geoloom.llm.simhash import GrayIndex, fingerprint, forest, gray_rank, later_copies, link_fingerprints, near_duplicates, op6_simhash_dedup, shingles

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if grams else 0


def slow_components(fps, distance=4):
    """fps: {id: fingerprint}"""
    ids = sorted(fps)
    best = {i: i for i in ids}

    def find(i):
        while best[i] != i:
            i = best[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                best[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    want = slow_components(fps)
    got = op6_simhash_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}
    assert len(got) == len(docs)


@pytest.mark.parametrize("bucket_rows", [40, 20_000])
def test_links_among_crowded_fingerprints(spark, bucket_rows):
    """Near copies crowd into the same buckets; small buckets make them be dealt again several times."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 4, dtype=np.int64)
    codes = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), False)) for b in base for _ in range(60)}
    codes |= {int(x) for x in rng.integers(0, 2**63, 100, dtype=np.int64)}
    want = slow_components({c: c for c in codes})
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    links = [(r.a % 2**64, r.b % 2**64) for r in link_fingerprints(df, "code", 4, bucket_rows).collect()]
    assert all(bin(want[a] ^ want[b]).count("1") == 0 for a, b in links)
    order = {c: k for k, c in enumerate(sorted(codes))}
    label = forest(len(order), [(np.array([order[a] for a, _ in links]), np.array([order[b] for _, b in links]))])
    assert {c: sorted(codes)[label[k]] for c, k in order.items()} == want


def test_index_finds_every_pair_and_prunes():
    rng = np.random.default_rng(1)
    codes = np.unique(np.concatenate([rng.integers(0, 2**63, 300).astype(np.uint64), np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))]))
    codes = codes[np.argsort(gray_rank(codes))]
    index = GrayIndex(codes, np.array([0, len(codes)]))
    q = np.arange(len(codes))
    a, b, _ = index.search(q, codes, np.zeros(len(codes), np.int64), 4)
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert len(got) == 301
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(100)}) == 1
    assert got[0] != got[1000]


def kept(spark, texts):
    rows = written(spark.createDataFrame(list(enumerate(texts)), "uid long, text string"), "test-rows")
    gone = {r.uid for r in later_copies(rows, "uid").collect()}
    return [k for k in range(len(texts)) if k not in gone]


def test_many_texts_of_one_fingerprint(spark):
    """21,000 pages of one template with a number of their own: one fingerprint, above bucket_rows at its default. Long ones are near copies, short ones are not."""
    rng = np.random.default_rng(7)
    line = "all rights reserved to the owner of this page " * 4
    short = [f"{line} {k}" for k in range(21_000)]
    assert len({fingerprint(t, 2) for t in short[:300]}) == 1
    words = rng.integers(0, 10**6, 300)
    long = [" ".join(f"w{x}" for x in words[:150]) + f" number {k} " + " ".join(f"w{x}" for x in words[150:]) for k in range(200)]
    stay = kept(spark, short + long)
    assert stay[0] == 0 and sum(k >= 21_000 for k in stay) == 1
    a, b = (set(shingles(short[k], 5).tolist()) for k in (3, 4))
    near = len(a & b) / len(a | b) >= 0.8
    assert sum(k < 21_000 for k in stay) == (1 if near else 21_000)


def test_members_of_a_fingerprint_are_told_apart(spark):
    """Texts of one fingerprint in three groups of near copies, dealt so that neighbours in any one order are often of different groups."""
    rng = np.random.default_rng(3)
    common = " ".join(["the same line again"] * 30)
    own = [[f"g{g}x{i}" for i in range(16)] for g in range(3)]
    texts = []
    for k in range(300):
        w = list(own[k % 3])
        w[int(rng.integers(0, 16))] = f"edit{k}" if rng.random() < 0.1 else w[0]
        texts.append(f"{common} {' '.join(w)} {common}")
    sets = [set(shingles(t, 5).tolist()) for t in texts]
    near = [(i, j) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = forest(300, [(np.array([i for i, _ in near]), np.array([j for _, j in near]))])
    want = sorted(set(label.tolist()))
    got = kept(spark, texts)
    assert len({fingerprint(t, 2) for t in texts}) < 100 and set(want) <= set(got) and len(got) <= len(want) + 0.02 * (300 - len(want))


def test_odd_rows(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.id: r for r in got}
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == 0 and by[2].component == 0
    assert by[8].component == by[9].component == 7
    assert near_duplicates(no_docs).count() == 0
