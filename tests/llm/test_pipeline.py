"""The pipeline's stages against plain versions, each on its own input."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from geoloom.llm.common import written
from geoloom.llm.secrets import scan

from .test_tokens import check_packs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert stages[1].columns == stages[0].columns and all(before[i] == r for i, r in after.items())
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = before.keys() - after.keys()
    assert np.mean([toxic[i] == 0 for i in gone if i in toxic]) < 0.1
    assert np.mean([i in after for i, y in toxic.items() if y == 0]) > 0.99
    assert np.mean([i in gone for i, y in toxic.items() if y == 1]) > 0.5


def groups_by_hand(texts):
    """Groups of documents whose five-word shingles have a Jaccard similarity of 0.8 or more with another's of the group."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [(t or "").encode().lower().split()]}
    group = {i: i for i in texts}

    def top(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = Counter((a, b) for h in holders.values() if len(h) < 400 for k, a in enumerate(h) for b in h[k + 1 :])
    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            x, y = sorted((top(a), top(b)))
            group[y] = x
    return {i: top(i) for i in texts}


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    group = groups_by_hand({i: r.text for i, r in before.items()})
    goes, gone = {i for i, g in group.items() if i != g}, before.keys() - after.keys()
    print(f"near copies: {len(gone & goes)} of {len(goes)} go")
    assert all(before[i] == r for i, r in after.items()) and stages[2].count() == len(after)
    assert gone <= goes and len(gone) >= 0.95 * len(goes)


def test_benchmark_items_go(spark, stages):
    before, after = rows(stages[2]), rows(stages[3])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(x in r.text for r in after.values() for x in items)
    assert all(before[i] == r for i, r in after.items()) and len(after) > 0.9 * len(before)


def test_secrets_are_marked(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        if scan(before[i].text):
            assert not scan(r.text) and "[" in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == before[i].text


def test_packs(stages):
    check_packs({i: r.text for i, r in rows(stages[4]).items()}, stages[5].collect(), 2048)


def test_odd_rows(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == odd_docs.columns
    ids = [r.doc_id for r in docs.collect()]
    assert 0 in ids and 1 not in ids and 7 in ids and 8 not in ids and len(ids) == len(set(ids))


def test_empty_table(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.count() == 0


def test_packing_of_odd_rows(spark, odd_docs):
    got = corpus_pipeline.packing(spark, odd_docs, SF).collect()
    assert sum(r.length for r in got if r.doc_id in (0, 1)) == 2 and sum(r.start == 0 for r in got) == odd_docs.count()


def test_null_and_repeated_ids_in_dedup_and_decontamination(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, words(k)) for k in range(5)] + [(None, words(0)), (3, words(10)), (3, words(11)), (3, words(10)), (4, words(12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.simhash_dedup(spark, docs, SF)
    assert sorted(r.text for r in kept.collect()) == sorted({t for _, t in rows})
    extra = spark.createDataFrame([(None, leak), (3, leak)], docs.schema)
    clean = corpus_pipeline.decontamination(spark, docs.unionByName(extra), SF)
    assert sorted((str(r.doc_id), r.text) for r in clean.collect()) == sorted((str(i), t) for i, t in rows)


def test_registered(spark):
    from geoloom.llm import queries

    assert queries.QUERIES["pipeline"] is corpus_pipeline.run and len(queries.QUERIES) == 14
