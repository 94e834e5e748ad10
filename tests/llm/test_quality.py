import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm.common import held_out
from geoloom.llm.quality import MARKS, NeighbourQuality, counts, op12_quality_neighbours, vote

SF = "/root/testdata/sf0.1"


def plain_features(text):
    """Names of a text's features with their counts, by loops."""
    kind = []
    for x in text:
        c = "a" if 97 <= x < 123 or x > 127 else "A" if 65 <= x < 91 else "0" if 48 <= x < 58 else chr(x) if x in MARKS else " "
        if not kind or kind[-1] != c:
            kind.append(c)
    out = Counter(tuple(kind[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(kind) - n + 1))
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    out["word again"] = sum(a == b for a, b in zip(words, words[1:]))
    out["new word"] = len(words) - out["word again"]
    out["line again"] = len(lines) - len(set(lines))
    out["new line"] = len(set(lines))
    return +out


def test_counts_against_loops():
    docs = [b"", b"a", b"One two  TWO, two two!\nx\nx\n\ny", b"\xc3\xa9t\xc3\xa9 12 %%% 3 *", b"", b" ", b"aa aa aa"]
    got = counts(docs, 1 << 16)
    for d, row in zip(docs, got):
        assert sorted(row[row > 0].tolist()) == sorted(plain_features(d).values())
        assert (counts([d], 1 << 16)[0] == row).all()


def test_vote_counts_all_that_are_as_near():
    known = np.array([[1.0, 0], [1, 0], [1, 0], [0, 1], [-1, 0]])
    labels = np.array([1.0, 0, 0, 1, 1])
    got = vote(np.array([[1.0, 0], [0, 1], [0.6, 0.8], [0, 0], [0, -1]]), known, labels, 2, 2, 0.25)
    both = (0.36 + 0.64) / (3 * 0.36 + 0.64)
    assert np.allclose(got, [1 / 3, 1, both, 0.25, 0.25])
    assert vote(np.ones((2, 2)), np.zeros((0, 2)), np.zeros(0), 3, 2, 0.5).tolist() == [0.5, 0.5]


def test_query_against_plain_search(spark):
    """Features by loops, the space by a singular value decomposition, neighbours one by one."""
    sf = SF.replace("0.1", "0.001")
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where(~held_out("doc_id", 4, 2)).collect() if r.doc_id in docs}
    place = defaultdict(lambda: len(place))
    single = lambda d: counts([d], 1024)[0]
    x = {i: np.log1p(single(d)) for i, d in docs.items()}
    assert all(sum(plain_features(d).values()) == single(d).sum() for d in docs.values())
    ids = sorted(labels)
    have = sum((x[i] > 0).astype(int) for i in ids)
    weight = np.where(have > 0, np.log((1 + len(ids)) / np.maximum(have, 1)), 0)
    rows = np.array([x[i] * weight / max(np.linalg.norm(x[i] * weight), 1e-300) for i in ids]).astype(float)
    axes = np.linalg.svd(rows, full_matrices=False)[2][:32].T
    vec = lambda v: v / max(np.linalg.norm(v), 1e-300)
    near = {i: vec((x[i] * weight) @ axes) for i in docs}
    for r in op12_quality_neighbours(spark, sf).collect():
        cosine = sorted(((float(near[r.doc_id] @ near[i]), labels[i]) for i in ids), reverse=True)
        cosine = [(c, y) for c, y in cosine if c >= cosine[14][0] - 1e-6 and c > 0]
        total = sum(c**4 for c, _ in cosine)
        want = sum(c**4 * y for c, y in cosine) / total if total else sum(labels.values()) / len(labels)
        assert math.isclose(r.score, want, abs_tol=2e-3), (r.doc_id, r.score, want)
        assert r.predicted == int(r.score >= 0.7)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = op12_quality_neighbours(spark, SF).where("held_out").join(labels, "doc_id").groupBy("quality").agg(F.avg("predicted").alias("p"), F.count("*").alias("n"))
    share = {r.quality: (r.p, r.n) for r in got.collect()}
    assert share[1][0] >= 0.98 and share[0][0] <= 0.05 and share[0][1] > 50


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 7), (4, 0, 7), (5, None, 7), (6, 5, 7), (99, 1, 7), (None, 0, 7), (3, 0, 7)], "doc_id long, quality int, score int")
    got = NeighbourQuality().fit(odd_docs, labels).score(odd_docs)
    assert got.columns == [*odd_docs.columns, "score_"] and got.count() == odd_docs.count()
    rows = got.collect()
    assert all(0 <= r.score_ <= 1 for r in rows)
    assert {r.score_ for r in rows if not r.text} == {0.0}  # of ids 3 (0 by one of its labels) and 4
    assert NeighbourQuality().fit(odd_docs, labels.limit(0)).score(odd_docs).where("score_ = 0.5").count() == odd_docs.count()
    assert NeighbourQuality().fit(no_docs, labels).score(no_docs).count() == 0
