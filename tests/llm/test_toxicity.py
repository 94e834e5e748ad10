import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm.common import byte_table, held_out, separator_mask
from geoloom.llm.toxicity import LETTERS, Ftrl, ToxicityModel, features, op2_toxicity

SF = "/root/testdata/sf0.1"


def test_features_against_a_plain_loop():
    table, mask = byte_table(23), separator_mask(LETTERS)
    docs = [b"", b"one", b"One, two three!", b"\xc3\xa9 x\ny  z"]
    f, d = features(docs, 1 << 20, table, mask)
    sizes = [np.count_nonzero(d == k) for k in range(4)]
    assert sizes == [1, 1 + 1, 1 + 3 + 2 + 1, 1 + 4 + 3 + 2]
    g, _ = features([b"one two three"], 1 << 20, table, mask)
    assert sorted(g) == sorted(f[d == 2])


def test_ftrl_keeps_what_tells_and_nothing_else():
    rng = np.random.default_rng(0)
    m = Ftrl(100, 2.0, 1.0, 6.0, 1e-3)
    for _ in range(600):
        y = int(rng.random() < 0.3)
        noise = rng.choice(np.arange(2, 100), 10, False)
        m.learn(np.concatenate(([0], [1] if y else [], noise)).astype(int), y)
    w = m.weights(slice(None))
    assert w[1] > 1 and np.count_nonzero(w[2:]) < 25


def test_query_against_plain_ftrl_over_dictionaries(spark):
    """Training and scores by a loop over dictionaries, on all labels of the small tables."""
    sf = SF.replace("0.1", "0.001")
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~held_out("doc_id", 3, 1)).withColumn("o", F.xxhash64("doc_id"))
    sample = [(r.o, r.doc_id, r.toxic) for r in labels.collect() if r.doc_id in docs and r.toxic in (0, 1)]
    table, mask = byte_table(23), separator_mask(LETTERS)
    feats = {i: sorted(set(features([t], 1 << 20, table, mask)[0].tolist())) for i, t in docs.items()}
    many = Counter(f for _, i, _ in sample for f in feats[i])
    alpha, beta, l1, l2, epochs = 2.0, 1.0, 12.0, 1e-3, 6
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else (math.copysign(l1, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for _, i, y in sorted(sample):
            live = [f for f in feats[i] if many[f] >= l1 // epochs + 1]
            w = {f: weight(f) for f in live}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for f in live:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    for r in op2_toxicity(spark, sf).collect():
        want = 1 / (1 + math.exp(-max(-35, min(35, sum(weight(f) for f in feats[r.doc_id] if f in n)))))
        assert math.isclose(r.score, want, rel_tol=1e-6, abs_tol=1e-9) and r.predicted == int(r.score >= 0.7)


def test_repeated_labels_and_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1)] * 20 + [(2, 0)] * 20, "doc_id long, toxic int")
    m = ToxicityModel(max_rows=2).fit(docs, labels)
    assert m.score(docs).count() == 51


def test_held_out_accuracy(spark):
    got = op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    pos, neg = got[got.toxic == 1], got[got.toxic == 0]
    assert (pos.predicted == 1).mean() > 0.6 and (neg.predicted == 0).mean() > 0.99
    auc = (pos.score.to_numpy()[:, None] > neg.score.to_numpy()[None]).mean()
    assert auc > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (777, 1), (4, 0)], "doc_id long, toxic int")
    m = ToxicityModel().fit(odd_docs, labels)
    assert m.score(odd_docs).where("score <> 7 or score_ is null").count() == 0  # a column of that name stays
    got = m.score(odd_docs.drop("score"))
    assert got.count() == odd_docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert m.score(no_docs).count() == 0
    none = ToxicityModel().fit(no_docs, labels.limit(0))
    assert {r.score for r in none.score(odd_docs.drop("score")).select("score").collect()} == {0.5}
    assert none.score(odd_docs.select(F.col("text"))).columns == ["text", "score"]
