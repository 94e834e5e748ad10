import hashlib
import zlib

import numpy as np
import pytest

from geoloom.llm.common import scratch_path
from geoloom.llm.media import GEAR, ChunkStore, cuts, op7_media_chunks, payload_of, put_together

SF = "/root/testdata/sf0.001"


def slow_cuts(data, bits=10, least=512, most=8192):
    out, at, h = [], 0, 0
    for k, b in enumerate(data, 1):
        h = ((h << 1) + int(GEAR[b])) % 2**32
        if k - at == most or (h >> (32 - bits) == 0 and k - at >= least):
            out.append(k)
            at = k
    return out + ([len(data)] if at < len(data) else [])


def test_cuts_against_a_rolling_loop():
    rng = np.random.default_rng(2)
    for n in (0, 1, 64, 5000, 60_000):
        data = rng.integers(97, 123, n, dtype=np.uint8).tobytes()
        assert cuts(data) == slow_cuts(data)
    assert cuts(b"a" * 50_000) == slow_cuts(b"a" * 50_000)


def test_query_round_trip(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op7_media_chunks(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id]
        p = payload_of(t.decode())
        assert len(p) % 64 == 0 and len(p) > 0 and p.startswith(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        ends = slow_cuts(p)
        pieces = [p[a:z] for a, z in zip([0, *ends], ends)]
        form = b"".join(hashlib.sha256(c).digest() + len(c).to_bytes(4, "little") for c in pieces) + p
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        assert r.feature == f"{len(pieces)}:{sum(p)}:{sum(b < a for a, b in zip(p, p[1:]))}"


def test_lost_or_altered_chunks_are_errors(spark):
    rng = np.random.default_rng(5)
    base = bytes(rng.integers(97, 123, 9_000, dtype=np.uint8)).decode()
    rows = [(1, base), (2, base), (3, "alone")]
    store = ChunkStore(spark, scratch_path(spark, "media-test"))
    store.write(spark.createDataFrame(rows, "doc_id long, text string"))
    chunks = [(bytes(r.digest), bytes(r.bytes)) for r in store.chunks().collect()]
    for bad in ([], chunks[1:], [(d, b"x" + c[1:]) for d, c in chunks]):
        broken = ChunkStore(spark, store.folder)
        broken.shape = store.shape
        frame = spark.createDataFrame(bad, "digest binary, bytes binary")
        broken.chunks = lambda frame=frame: frame
        with pytest.raises(Exception, match="chunk"):
            broken.read().collect()
    whole = [r for r in store.lists().collect() if r.id == 3][0]
    assert put_together(whole.n_bytes, bytes(whole.sha256), bytes(whole.recipe), bytes(whole.own), {}) == payload_of("alone")
    with pytest.raises(ValueError, match="payload"):
        put_together(whole.n_bytes + 64, bytes(whole.sha256), bytes(whole.recipe), bytes(whole.own), {})
    with pytest.raises(ValueError, match="payload"):
        put_together(whole.n_bytes, bytes(32), bytes(whole.recipe), bytes(whole.own), {})


def test_shared_chunks_are_stored_once(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 123, 40_000, dtype=np.uint8)).decode()
    rows = [(k, base[: 20_000 + k] + f"own {k} " + base[20_000:]) for k in range(30)] + [(99, base), (99, base), (7, "nul\0"), (8, None)]
    store = ChunkStore(spark, scratch_path(spark, "media-test"))
    store.write(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.id, r.n_bytes, bytes(r.payload)) for r in store.read().collect())
    assert got == sorted((i, len((t or "").encode()), payload_of(t)) for i, t in rows)
    kept = spark.read.parquet(f"{store.folder}/chunks").selectExpr("sum(length(bytes))").collect()[0][0]
    assert kept < 45_000
    odd = ChunkStore(spark, scratch_path(spark, "media-test"))
    odd.write(odd_docs)
    assert odd.read().count() == odd_docs.count()
    none = ChunkStore(spark, scratch_path(spark, "media-test"))
    none.write(no_docs)
    assert none.read().count() == 0
