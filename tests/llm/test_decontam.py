import numpy as np

from geoloom.llm.common import sent_bitmap, word_spans
from geoloom.llm.decontam import Decontaminator, alignments, op3_decontamination

SF = "/root/testdata/sf0.01"


def slow_align(text, item):
    best, h = 0, np.zeros((len(item) + 1, len(text) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_against_a_plain_table():
    rng = np.random.default_rng(3)
    rows = [(rng.integers(2, 8, rng.integers(1, 40)).astype(np.uint64), rng.integers(2, 8, rng.integers(1, 25)).astype(np.uint64)) for _ in range(60)]
    got = alignments(rows)
    assert got[:, 0].tolist() == [slow_align(t, i) for t, i in rows]
    for (t, i), (score, a, z) in zip(rows, got):
        assert 0 <= a <= z <= len(t) and slow_align(t[a:z], i) == score


def test_query_finds_every_pasted_item(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    pasted = {(i, j) for i, t in docs.items() for j, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id): r for r in op3_decontamination(spark, SF).collect()}
    assert pasted and pasted <= got.keys()
    assert all(got[k].score == 1.0 for k in pasted)
    words = lambda t: [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t).lower().split()]
    for (i, j), r in got.items():
        assert slow_align(words(docs[i]), words(items[j])) / (2 * len(words(items[j]))) >= 0.5


def test_recall_against_exhaustive_alignment(spark):
    """Every document against every item, without seeds: at least nine in ten of the pairs that pass the threshold are found, and no others."""
    d = Decontaminator()

    def words(rows):
        *_, h, first = word_spans([(r[1] or "").encode() for r in rows], d.mask, d.table)
        return [h[a:z] for a, z in zip(first, first[1:])]

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dw, iw = words(docs), words(items)
    pairs = [(a, b) for a in range(len(docs)) for b in range(len(items)) if np.isin(iw[b], dw[a]).mean() >= 0.5]
    score = alignments([(dw[a], iw[b]) for a, b in pairs])[:, 0]
    want = {(docs[a][0], items[b][0]) for (a, b), s in zip(pairs, score) if s / (2 * len(iw[b])) >= 0.5}
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, SF).collect()}
    print(f"recall against exhaustive alignment: {len(got & want)} of {len(want)}")
    assert want and got <= want and len(got & want) >= 0.9 * len(want)


def test_one_long_item_does_not_widen_the_others(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    short, long = [word() for _ in range(12)], [word() for _ in range(3000)]
    docs = spark.createDataFrame([(1, " ".join([word() for _ in range(2000)] + short + [word() for _ in range(2000)])), (2, " ".join(long)), (None, " ".join(short)), (None, " ".join(short)), (5, " ".join(short)), (5, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    d = Decontaminator()
    got = sorted((str(r.id), r.item_id, r.matched) for r in d.find(docs, bench).collect())
    assert got == [("1", 1, 12), ("2", 2, 3000), ("5", 1, 12), ("None", 1, 12), ("None", 1, 12)]
    items = d._items(bench, "item_id", "text")
    seeds = items.selectExpr("explode(grams) as g")
    kept = {r.id: len(r.words) // 8 for r in d._passages(docs.where("doc_id < 3"), "doc_id", "text", sent_bitmap(seeds), d._reach(items)).collect()}
    assert kept[1] < 150
    assert [r.text for r in d.clean(docs, bench).collect()] == ["clean"]


def test_edited_and_hot_copies(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    item = [word() for _ in range(40)]
    rows = []
    for k in range(300):
        own = [word() for _ in range(30)]
        copy = [w if rng.random() > 0.12 else word() for w in item] if k % 3 == 0 else item if k % 3 == 1 else []
        rows.append((k, " ".join(own[:15] + copy + own[15:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(word() for _ in range(30))), (3, "too short"), (4, None)], "item_id long, text string")
    got = {r.id for r in Decontaminator().find(docs, bench).collect()}
    assert got == {k for k in range(300) if k % 3 != 2}
    assert {r.doc_id for r in Decontaminator().clean(docs, bench).collect()} == {k for k in range(300) if k % 3 == 2}


def test_edited_copies_whose_seeds_are_all_frequent(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    item = [word() for _ in range(40)]
    edited = item[:13] + [word()] + item[14:28] + [word()] + item[29:35] + [word()] + item[36:]
    rows = []
    for k in range(90):
        own = [word() for _ in range(30)]
        copy = item if k < 3 else edited if k < 60 else item[20:25]  # only a stock phrase of the item in the last
        rows.append((k, " ".join(own[:15] + copy + own[15:])))
    rows += [(k, rows[5][1]) for k in range(90, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.id: r for r in Decontaminator().find(docs, bench).collect()}
    assert got.keys() == {*range(60), *range(90, 120)}
    assert all(got[k][1:] == got[5][1:] for k in range(90, 120))


def test_a_stock_phrase_of_many_items_makes_few_pairs(spark):
    """One 5-gram in 1,000 items and 2,000 passages: no pair of each with each, and copies of items are still found."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    stock = "please answer with one letter"
    items = [(k, " ".join([word() for _ in range(9)] + [stock] + [word() for _ in range(9)])) for k in range(1000)]
    texts = [(k, " ".join([word() for _ in range(20)] + [stock] + [word() for _ in range(20)])) for k in range(2000)]
    for k in range(0, 2000, 200):
        w = items[k // 2][1].split()
        w[3] = word()
        texts[k] = (k, texts[k][1] + " " + " ".join(w))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    d = Decontaminator()
    seeds = d._seeds(d._items(bench, "item_id", "text"))
    assert seeds.groupBy("g").count().agg({"count": "max"}).first()[0] <= d.rare
    assert {(r.id, r.item_id) for r in d.find(docs, bench).collect()} == {(k, k // 2) for k in range(0, 2000, 200)}


def test_items_that_are_alike_are_each_found(spark):
    """Sixty items of one template: all n-grams but a few are frequent; a passage of the template is found for each."""
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    frame = [word() for _ in range(30)]
    items = [(k, " ".join(frame[:15] + [word()] + frame[15:])) for k in range(60)] + [(100, items_text) for items_text in [" ".join(frame[:15] + ["x"] + frame[15:])]] + [(101, " ".join(frame[:15] + ["X"] + frame[15:]))]
    docs = spark.createDataFrame([(1, " ".join([word() for _ in range(5)] + frame[:15] + ["other"] + frame[15:])), (2, " ".join(frame[13:17])), (3, " ".join(word() for _ in range(40)))], "doc_id long, text string")
    got = Decontaminator().find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item_id) for r in got} == {(1, i) for i, _ in items}


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "so it goes they say"), (2, "it goes"), (3, "goes it so"), (4, "what is up, Doc?"), (5, "yes"), (6, "Bold new world order now")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "So it goes"), (2, "What is up doc"), (3, "yes"), (4, "new world")], "item_id long, text string")
    assert {(r.id, r.item_id) for r in Decontaminator().find(docs, bench).collect()} == {(1, 1), (4, 2)}
    assert {(r.id, r.item_id) for r in Decontaminator(shortest=1).find(docs, bench).collect()} == {(1, 1), (4, 2), (5, 3), (6, 4)}


def test_alignments_with_many_gaps(spark):
    """A copy with a word put in after every two: the alignment is longer than its item by half."""
    rng = np.random.default_rng(14)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    item = [word() for _ in range(60)]
    spread = [w for k, x in enumerate(item) for w in ([x, word()] if k % 2 and k > 9 else [x])]
    docs = spark.createDataFrame([(1, " ".join([word() for _ in range(100)] + spread + [word() for _ in range(100)]))], "doc_id long, text string")
    d = Decontaminator()
    (r,) = d.find(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert r.score == slow_align(spread, item) / 120 and r.end - r.begin == len(spread) - 1


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "same text here now same text here"), (None, "no id at all here"), (2, "")], "item_id long, text string")
    got = Decontaminator().find(odd_docs, bench).collect()
    assert {(r.id, r.item_id) for r in got} == {(7, 1), (8, 1), (9, 1)}
    assert Decontaminator().clean(odd_docs, bench).columns == odd_docs.columns
    assert Decontaminator().find(no_docs, bench).count() == 0
    assert Decontaminator().find(odd_docs, bench.limit(0)).count() == 0
