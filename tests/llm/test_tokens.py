import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoloom.llm.packing import PIECE, number_by_length, op9_packing, pack, shortest_pack_first
from geoloom.llm.token_counts import TokenCounts, op10_token_counts
from geoloom.llm.tokens import PretokenIds

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ODD = ["", " ", "  two  spaces ", "it's don't we'll", "\n\n\t x", "é ü 漢字 🙂 ", "a<|endoftext|>b <|endoftext|>", "1234 5,6.7 $$$", "x" * 3000, "nul \0 byte"]


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_librarys(spark):
    own = PretokenIds(PATH, P.PATTERN)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["".join(chr(c) for c in range(k, k + 40)) for k in range(0, 12_000, 40)] + [None]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == ids_of(t)


def test_kept_ids_are_forgotten_without_harm():
    own = PretokenIds(PATH, P.PATTERN, most=50)
    texts = [f"a{k} b{k % 7} " * 3 for k in range(400)] * 2
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == ids_of(t)
        assert len(own) <= 50


def test_packing_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_packing(spark, SF).collect()
    check_packs(docs, rows, 2048)
    # sequences are padded to 2048, except at a power of two
    full = {}
    for r in rows:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in full.values())
    print(f"padding: {padded} of {padded + sum(full.values())}")
    assert padded <= 0.03 * sum(full.values())


def check_packs(docs, rows, size):
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == docs.keys()
    for i, pieces in by.items():
        ids, at = [*ids_of(docs[i]), 1], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            own = ids[at : at + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += p.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size


@pytest.mark.parametrize("coalesce", [True, False])
def test_a_length_in_many_ranges_is_packed_whole(spark, coalesce):
    text = F.when(F.col("id") % 3 == 0, "one two three four five").otherwise(F.expr("repeat('a b ', cast(id % 40 as int))"))
    docs = spark.range(0, 6000, 1, 7).select(F.col("id").alias("doc_id"), text.alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(coalesce).lower())
    try:
        rows = pack(docs, PATH, P.PATTERN, size=64).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check_packs({r.doc_id: r.text for r in docs.collect()}, rows, 64)


def test_pieces_are_numbered_over_batches(spark):
    lengths = [3] * 5 + [4] + [9] * 7
    rows = spark.createDataFrame([(i, 0, n, 0, 0, 0, 0) for i, n in enumerate(lengths)], PIECE.format("long", "")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = rows.sortWithinPartitions("length", "id").mapInArrow(number_by_length, PIECE.format("long", "")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.nth for r in sorted(got, key=lambda r: r.id)] == [0, 1, 2, 3, 4, 0, 0, 1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(rng.integers(1, 50)) for n in rng.integers(1, 65, 30)}
    got = {}
    for n, lengths in shortest_pack_first(counts, 64):
        assert sum(lengths) <= 64 and n > 0
        for x in lengths:
            got[x] = got.get(x, 0) + n
    assert got == counts


def test_counts_against_the_library_and_cache(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op10_token_counts(spark, SF).collect():
        n = len(ids_of(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_only_misses_are_encoded(spark, tmp_path):
    cache = TokenCounts(spark, PATH, P.PATTERN, str(tmp_path / "cache"))
    a = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens) for r in cache.count(a).collect()} == {(1, 2), (2, 2), (3, 0)}
    rows = lambda: spark.read.parquet(str(tmp_path / "cache")).count()
    assert rows() == 2
    again = TokenCounts(spark, PATH, P.PATTERN, str(tmp_path / "cache"))
    b = a.unionByName(spark.createDataFrame([(4, "new")], "doc_id long, text string"))
    assert again.count(b).count() == 4 and rows() == 3


def test_counts_when_rows_come_in_another_order_each_time(spark):
    def shuffled(batches):
        for b in batches:
            yield b.take(np.random.default_rng().permutation(b.num_rows))

    docs = spark.createDataFrame([(k, f"text {k % 100}") for k in range(300)], "doc_id long, text string").coalesce(1).mapInArrow(shuffled, "doc_id long, text string")
    got = TokenCounts(spark, PATH, P.PATTERN).count(docs).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(ids_of(f"text {k % 100}")) for k in range(300)}


def test_a_content_without_count_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(TokenCounts, "encode_misses", lambda *args: None)
    with pytest.raises(Exception, match="no token count"):
        op10_token_counts(spark, SF).collect()


def test_odd_rows(spark, odd_docs, no_docs):
    cache = TokenCounts(spark, PATH, P.PATTERN)
    got = cache.count(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.n_tokens_ for r in got if r.doc_id in (0, 1)} == {0} and {r.n_tokens for r in got} == {7}
    packed = pack(odd_docs, PATH, P.PATTERN).collect()
    assert sum(r.length for r in packed) == sum(r.n_tokens_ + 1 for r in got)
    assert pack(no_docs, PATH, P.PATTERN).count() == 0 and cache.count(no_docs).count() == 0
