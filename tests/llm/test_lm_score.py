import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm.lm_score import LogFrequencyBloom, op1_lm_score, rare_class, thresholds, word_keys

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def by_hand(docs, train):
    counts = Counter(t for i, x in train for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, x in docs:
        tk = tokens(x)
        out[i] = (len(tk), sum(counts[t] > 0 for t in tk), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tk))
    return out


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    train = [(i, x) for i, x in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    want = by_hand(docs, train)
    got = op1_lm_score(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score < 0
    seen = [r for r in got if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)
    assert sum(r.score for r in got if r.held_out) > 1.02 * sum(r.base_score for r in got if r.held_out)


def scores_by_hand(docs, train, growth=1.5, mu=100.0, share=0.5, margin=0.0, head_from=0, hashed=None):
    """The model's formula over exact dictionaries; hashed(words) gives the classes of rare words and their number."""
    words, pairs = Counter(), Counter()
    for _, x in train:
        tk = tokens(x)
        words.update(tk)
        pairs.update(zip(["<s>", *tk], tk))
    head = {w for w, c in words.items() if w != "\n" and c >= head_from}
    others = sorted({t for _, x in docs for t in tokens(x)} | set(words) - {"\n"})
    others = [t for t in others if t not in head and t != "\n"]
    own, n_classes = hashed(others) if hashed else ([0] * len(others), 1)
    kind_of = dict(zip(others, (("rare", k) for k in own)))
    name = lambda t: kind_of.get(t, t)
    n = sum(words.values())
    classes = Counter({"<s>": len(train), "\n": len(train)}) + Counter({w: words[w] for w in head})
    types = Counter()
    for t in others:
        classes[name(t)] += words[t]
        types[name(t)] += words[t] > 0
    joint = Counter()
    for (a, b), c in pairs.items():
        joint[name(a), name(b)] += c
    levels = thresholds(growth)

    def p(a, b):
        q = int(np.searchsorted(levels, joint[a, b], "right"))
        j = min(int(levels[q - 1]) - 1 if q else 0, classes[a], classes[b])
        return (j + (mu + share * classes[a]) * (classes[b] + 1) / (n + len(head) + 1 + n_classes)) / ((1 + share) * classes[a] + mu + margin)

    out = {}
    for i, x in docs:
        tk = tokens(x)
        kinds = [name(t) for t in tk]
        out[i] = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *kinds], kinds)) + sum(math.log10((words[t] + 1) / (classes[k] + types[k] + 1)) for t, k in zip(tk, kinds) if t in kind_of)
    return out


def hashed_by(m):
    n = len(m.classes.rare_bottom)
    return lambda words: (rare_class(word_keys([w.encode() for w in words], m.table, m.is_word), n).tolist(), n)


@pytest.mark.parametrize("more", [{}, {"head_words": 400}, {"head_words": 400, "rare_classes": 1}, {"head_words": 400, "ngrams_per_segment": 5000, "max_filter_bytes": 50_000}, {"head_words": 400, "ngrams_per_segment": 5000, "max_filter_bytes": 50_000, "most_passes": 1, "hot_pairs": 500}])
def test_score_against_brute_force_with_one_file_and_with_several(spark, more):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in rows.collect()]
    m = LogFrequencyBloom(probes=20, sure_probes=24, bits_per_probe=4.0, **more).fit(rows)  # next to no false positives
    assert (len(m.files) > 1) == ("max_filter_bytes" in more)
    want = scores_by_hand(docs, docs, margin=m.model.margin, head_from=m.head_from, hashed=hashed_by(m))
    for r in m.score(rows).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9)


def test_query_scores_differ_from_exact_levels_by_false_positives_only(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    train = [(i, x) for i, x in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    got = {r.doc_id: r.score for r in op1_lm_score(spark, SF).collect()}
    want = scores_by_hand(docs, train, margin=16.0)
    assert all(want[i] * 1.01 < got[i] < want[i] * 0.97 + 1e-9 for i in want)


@pytest.mark.parametrize("hot_pairs", [1, 300, 500_000])
def test_neither_files_nor_the_way_change_scores(spark, hot_pairs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "of the " * 3000), (-2, None), (-3, "of the " * 3000), (-4, "")], docs.schema))
    one = LogFrequencyBloom(head_words=50, ngrams_per_segment=5000).fit(docs)
    small = {"head_words": 50, "ngrams_per_segment": 5000, "max_filter_bytes": 5_000}
    more = LogFrequencyBloom(**small, most_passes=1000).fit(docs)
    shuffled = LogFrequencyBloom(**small, most_passes=2, hot_pairs=hot_pairs).fit(docs)
    assert len(one.files) == 1 and len(more.files) == len(shuffled.files) > 2
    a, b, c = ({r.doc_id: r for r in m.score(docs).collect()} for m in (one, more, shuffled))
    assert a.keys() == b.keys() == c.keys()
    for i in a:
        for other in (b[i], c[i]):
            assert (a[i].n_tokens, a[i].n_known) == (other.n_tokens, other.n_known)
            assert math.isclose(a[i].base_score, other.base_score, rel_tol=1e-12) and math.isclose(a[i].score, other.score, rel_tol=1e-10)


def test_hot_pairs_are_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    m = LogFrequencyBloom(hot_pairs=5000).fit(docs)
    assert 0 < sum(len(r.hot) // 8 for r in m.filled.collect()) <= 5000


def test_pairs_of_rare_words_are_in_the_filter(spark):
    """Rare words that follow each other get higher scores than the same words in another order; one class for all of them can't tell."""
    rows = [(i, f"common common rare{i % 50}a rare{i % 50}b common") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common common rare7a rare7b common"), (2, "common common rare7a rare31b common")], "doc_id long, text string")
    got = {n: {r.doc_id: r.score for r in LogFrequencyBloom(head_words=1, rare_classes=n).fit(docs).score(asked).collect()} for n in (1, 1 << 18)}
    assert math.isclose(got[1][1], got[1][2], rel_tol=1e-9)
    assert got[1 << 18][1] > got[1 << 18][2] + 0.5


def test_scores_with_few_head_words_stay_near_those_with_all(spark):
    """What head_words changes is smoothing only: the sum of scores stays far nearer to the full model's than with one class for all rarer words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    total = lambda **k: LogFrequencyBloom(**k).fit(docs).score(docs).agg(F.sum("score")).collect()[0][0]
    full, classes, one = total(), total(head_words=300), total(head_words=300, rare_classes=1)
    assert abs(classes - full) < 0.5 * abs(one - full)


@pytest.mark.parametrize("head_words", [300_000, 400])
def test_probabilities_after_any_class_sum_to_one_at_most(spark, head_words):
    m = LogFrequencyBloom(head_words=head_words).fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    k, filter_ = m.classes, m.filter()
    contexts = np.concatenate((np.argsort(-k.counts[: k.n])[:100], np.arange(0, k.n, max(1, k.n // 200)), np.arange(k.rare, len(k.counts), max(1, len(k.rare_bottom) // 100)), [k.start]))
    after = np.delete(np.arange(len(k.counts)), k.start).astype(np.uint64)
    assert len(after) == k.successors
    for a in contexts.astype(np.uint64):
        pairs = (a << np.uint64(32)) | after
        assert 0.4 < (10.0 ** m.model.log10(pairs, filter_.level(pairs))).sum() <= 1


def test_levels_are_never_lost(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3}") for i in range(100)], "doc_id long, text string")
    m = LogFrequencyBloom().fit(docs)
    rows = [np.frombuffer(r.ids, np.int32) for r in m.encode(docs).collect()]
    counts = Counter((int(a), int(b)) for ids in rows for a, b in zip([m.classes.start, *ids], [*ids, m.classes.end]))
    pairs = np.array([a << 32 | b for a, b in counts], np.uint64)
    got = m.filter().level(pairs)
    want = np.searchsorted(thresholds(1.5), list(counts.values()), "right")
    assert (got >= want).all() and (got == want).mean() > 0.8


def test_odd_rows(spark, odd_docs, no_docs):
    m = LogFrequencyBloom().fit(odd_docs)
    got = m.score(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert m.score(no_docs).count() == 0
    none = LogFrequencyBloom().fit(no_docs)
    assert none.score(odd_docs).where(F.col("train_tokens") != 0).count() == 0
