import hashlib
import re

from geoloom.llm.secrets import op8_secret_scan, redact, redact_secrets, scan, scan_secrets

SF = "/root/testdata/sf0.1"
PATTERNS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
)


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, flags, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "", flags) if ok(m)]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


def test_query_against_plain_patterns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_secret_scan(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(","))


def test_edges_of_the_patterns():
    for text in ("TOKEN = 'abc'", "token=abcdef", 'Api_Key": "x.y-z/1+=', "apikey:\tabcdefg", "paſſword=abcdefg", "AKIAAKIA" + "A" * 16, "f" * 23, "é" + "f" * 24, "password=token=abcdef", "secret" * 3 + "=1234567"):
        assert [f"{k}:{s}:{e}" for s, e, k, _ in scan(text) if k != "token"] == base_spans(text)


def test_owners_tell_examples_from_live_ones(spark):
    key = "AKIA" + "B7" * 8
    rows = [(k, f"example {key} here", f"s{k}") for k in range(10)] + [(20, "token = 'x9Kd83hsLq02'", "s1"), (21, "mine Zk39fLq0Xw7RtY2uVb8NmC4d", "s1"), (22, None, None), (22, "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.secrets for r in scan_secrets(docs).collect() if r.doc_id != 22}
    assert (got[0][0].owners, got[0][0].repositories, got[0][0].live) == (10, 10, False)
    assert [s.kind for s in got[20]] == ["assign"] and got[20][0].live and got[21][0].kind == "token"
    clean = {r.doc_id: r.text for r in redact_secrets(docs).where("doc_id <> 22").collect()}
    assert clean[0] == "example [example access] here" and clean[20] == "[redacted assign]'" and clean[21] == "mine [redacted token]"


def test_query_reports_tokens_by_their_owners(spark, tmp_path):
    """Planted in a folder of their own: a token that two sources hold is a span, one that five hold is none; base spans stay whoever holds them."""
    live, example, key = "q7w8-e9r0-t1y2-u3i4-o5p6", "a1b2-c3d4-e5f6-g7h8-i9j0", "AKIA" + "C3D4" * 4
    rows = [(k, f"see {example} and {key}", f"s{k}") for k in range(5)] + [(10 + k, f"see {live} now", f"s{k % 2}") for k in range(6)] + [(20, None, "s1"), (21, "nothing here", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_secret_scan(spark, str(tmp_path)).collect()}
    at = len(f"see {example} and ")
    assert {got[k].spans for k in range(5)} == {f"access:{at}:{at + 20}"} and {got[k].n_live for k in range(5)} == {0}
    assert {got[10 + k].spans for k in range(6)} == {f"token:4:{4 + len(live)}"}
    assert got[20].spans == got[21].spans == "" and len(got) == len(rows)


def test_ownership_decides_spans_in_the_given_documents(spark):
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    owners = {}
    for text, source in docs.values():
        for _, _, _, v in scan(text):
            owners.setdefault(v, set()).add(source)
    rows = op8_secret_scan(spark, SF).collect()
    for r in rows:
        want = [f"{k}:{s}:{e}" for s, e, k, v in scan(docs[r.doc_id][0]) if k != "token" or len(owners[v]) <= 2]
        assert r.spans == ",".join(want)
    tokens = [v for t, _ in docs.values() for _, _, k, v in scan(t) if k == "token"]
    assert any(len(owners[v]) <= 2 for v in tokens)


def test_overlapping_spans_become_one_mark():
    span = lambda s, e: {"start": s, "end": e, "kind": "hex", "live": True}
    assert redact(["0123456789"], [[span(2, 6), span(3, 5), span(5, 8)]]) == ["01[redacted hex]89"]


def test_odd_rows(spark, odd_docs, no_docs):
    assert scan_secrets(odd_docs).count() == odd_docs.count()
    kept = scan_secrets(odd_docs, keep=("uid", "score", "digest"))
    assert kept.columns == ["doc_id", "source", "uid", "score", "digest", "secrets"] and kept.where("uid <> 7 or digest <> 7").count() == 0
    same = redact_secrets(odd_docs)
    assert same.columns == odd_docs.columns and same.exceptAll(odd_docs).count() == 0
    assert scan_secrets(no_docs).count() == 0 and redact_secrets(no_docs).count() == 0
