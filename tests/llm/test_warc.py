import base64
import hashlib

from geoloom.llm.common import scratch_path
from geoloom.llm.warc import MAGIC, archive, op5_warc, read_archives, records_of, write_archives

SF = "/root/testdata/sf0.001"
SHAPE = "page_id long, url string, html string, part int, digest string"


def by_hand(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, _, html in rows:
        data = (html or "").encode()
        low = first.get(html or "")
        again = low is not None and i != low
        yield i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", low if again else None


def test_query_against_brute_force(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in op5_warc(spark, SF).collect()]
    assert sorted(got) == sorted(by_hand(rows))


def test_round_trip_of_odd_rows(spark):
    rows = [(1, "http://a/", "x" * 40), (2, None, "x" * 40), (2, None, "x" * 40), (3, "bad\r\nurl", None), (4, "u", ""), (5, "u", "é🙂\r\n\r\nWARC/1.1"), (None, "u", "x" * 40), (None, "u", "alone"), (6, "u", "long " * 300_000)]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], SHAPE)
    folder = scratch_path(spark, "warc-test")
    write_archives(df, folder, file_bytes=1000)
    got = read_archives(spark, folder).collect()
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(by_hand(rows), key=key)
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {r[2] or "" for r in rows}
    empty = scratch_path(spark, "warc-test")
    write_archives(df.limit(0), empty)
    assert read_archives(spark, empty).count() == 0


def test_archive_begins_with_its_dictionary():
    records = [f"record {k} of many with much the same words in it, number {k * 7}".encode() * 3 for k in range(400)]
    data = archive(records, size=2048)
    assert int.from_bytes(data[:4], "little") == MAGIC
    assert list(records_of(data)) == records
    assert list(records_of(archive([b"one"]))) == [b"one"]
    assert len(data) < sum(map(len, records)) // 3
