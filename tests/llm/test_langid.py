import math

import numpy as np
import public_tokenizers as P

from geoloom.llm.common import held_out
from geoloom.llm.langid import LanguageModel, Lattice, by_length, expected, fold, forward, op4_language_id

SF = "/root/testdata/sf0.01"


def splits(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in splits(word[n:], pieces):
                yield [word[:n], *rest]


def test_forward_and_counts_against_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b" ", b" a", b" ab"]
    p = np.random.default_rng(0).random((len(pieces), 2)) / 4
    lattice = Lattice(pieces)
    for word in ("abab", "baab", "a", "bbaabab"):
        (at, rows), = by_length([word])
        ways = list(splits(b" " + word.encode(), set(pieces)))
        each = np.array([[math.prod(p[pieces.index(x), k] for x in w) for w in ways] for k in range(2)])
        assert np.allclose(forward(lattice, rows, p)[0], np.log(each.sum(1)))
        want = np.zeros(len(pieces))
        for w, m in zip(ways, each[0]):
            for x in w:
                want[pieces.index(x)] += 3 * m / each[0].sum()
        assert np.allclose(expected(lattice, rows, p[:, 0], np.array([3.0])), want)


def test_counts_of_long_words_equal_those_of_short_ones():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b" ", b" a", b" ab"]
    p = np.random.default_rng(1).random((len(pieces), 1)) / 4
    lattice = Lattice(pieces)
    (at, rows), = by_length(["abbabaabab", "babaababba"])
    n = np.array([2.0, 5.0])
    assert np.allclose(expected(lattice, rows, p[:, 0], n), expected(lattice, rows, p[:, 0], n, plain=0))
    (at, rows), = by_length(["ab" * 1000])
    got = expected(lattice, rows, p[:, 0] * 1e-3, np.array([1.0]))
    assert np.isclose(sum(len(x) * c for x, c in zip(pieces, got)), 2001)


def test_query_against_a_plain_forward_sum(spark):
    sf = SF.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = LanguageModel(P.path("piece_bpe_32k.model")).fit(docs.where(~held_out("doc_id", 5, 0)))
    place = {x: k for k, x in enumerate(m.pieces)}
    longest = max(map(len, m.pieces))
    known = {}

    def slow(word):
        raw = b" " + word.encode()
        sums = [np.ones(len(m.langs))] + [np.zeros(len(m.langs)) for _ in raw]
        for j in range(1, len(raw) + 1):
            for i in range(max(0, j - longest), j):
                k = place.get(raw[i:j])
                if k is not None:
                    sums[j] = sums[j] + sums[i] * m.p[k]
        return np.log(sums[-1])

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op4_language_id(spark, sf).collect():
        words = fold(texts[r.doc_id])
        if any(len(w.encode()) > 60 for w in words):
            continue
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum(known.setdefault(w, slow(w)) if w not in known else known[w] for w in words)
        best = int(np.argmax(total))
        assert r.lang_pred == m.langs[best] and np.isclose(r.score, 1 / np.exp(total - total[best]).sum())


def test_scripts_without_spaces(spark):
    rng = np.random.default_rng(6)
    zh, ja = "的一是不了人我在有他这中大来上国个到说们", "のにはをたがでてとしれさあるいもするから"
    line = lambda letters: "".join(rng.choice(list(letters + "日本年月学生"), 40))
    rows = [(k, " ".join(line(zh if k % 2 else ja) for _ in range(3)), "zh" if k % 2 else "ja") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = LanguageModel(P.path("piece_bpe_32k.model")).fit(df.where("doc_id < 60"))
    got = m.predict(df.where("doc_id >= 60")).collect()
    assert np.mean([r.language.lang == r.lang for r in got]) > 0.9
    assert not np.allclose(m.p[:, 0], m.p[:, 1])


def test_long_words_do_not_underflow():
    pieces = [bytes([b]) for b in range(256)]
    p = np.full((256, 3), 1e-9)
    (at, rows), = by_length(["x" * 3000])
    assert np.allclose(forward(Lattice(pieces), rows, p), 3001 * math.log(1e-9))


def test_held_out_accuracy(spark):
    got = op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98


def test_odd_rows(spark, odd_docs, no_docs):
    path = P.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("", "de"), ("no language", None)], "text string, lang string")
    m = LanguageModel(path).fit(rows)
    assert m.langs == ["de", "en", "fr"]
    got = {r.doc_id: r.language for r in m.predict(odd_docs).collect()}
    assert [got[i].lang for i in (0, 1, 2, 11)] == ["und"] * 4
    assert got[3].lang in m.langs and 0 <= got[3].score <= 1
    assert m.predict(no_docs).count() == 0
    twice = m.predict(m.predict(odd_docs))
    assert twice.columns[-2:] == ["language", "language_"] and twice.where("language.lang <> language_.lang").count() == 0
    assert {r.language.lang for r in LanguageModel(path).fit(rows.limit(0)).predict(odd_docs).collect()} == {"und"}
