import hashlib
import heapq
import random

import duckdb
import numpy as np
import pytest

from geoloom.llm import conversations
from geoloom.llm.conversations import END, FAR, LETTERS, OP13_SQL, least_paths, matrices, op13_conversation_repair, repair, streamed_sha256

SHAPE = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
PAIRS = {"": "su", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The cheapest edits of one conversation, least letters first, by Dijkstra over (rows used, last role)."""
    kinds = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        if (i, last) in done:
            continue
        done.add((i, last))
        fill = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[fill]
        heapq.heappush(heap, (cost + 3, audit + "I", i, fill, (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 * (kinds[i] == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, fill, (*out, (name, text))))
                if role[:1] and role[:1] in PAIRS[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
    raise AssertionError


def report_of(rows):
    kinds, initials = faults(rows), [role[:1] for role, _ in rows]
    cost, audit, out = plain_repair(rows)
    bad = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    return (kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), bad, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def talk(rng, n):
    roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user"], ["system", "tool", "user", "assistant", ""]])
    texts = rng.choice([["One.", "two", "", "Three!", " \t"], [f"text {k}?" for k in range(500)], ["cut off", "whole."]])
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_matrices_against_all_ways():
    rng = np.random.default_rng(3)
    codes = [rng.integers(0, 16, n) for n in (0, 1, 2, 5, 3, 1)]
    got = matrices(codes)
    assert got[0].tolist() == np.where(np.eye(4, dtype=bool), 0, FAR).tolist()
    for c, m in zip(codes, got):
        want = np.where(np.eye(4, dtype=bool), 0, FAR)
        for x in c:
            row = conversations.ROW[x]
            want = np.array([[min(want[s, k] + row[k, t] for k in range(4)) for t in range(4)] for s in range(4)])
        assert (m == np.minimum(want, FAR)).all()


def test_least_paths_rank_by_audit():
    rng = np.random.default_rng(4)
    for _ in range(30):
        codes = [rng.integers(0, 16, n) for n in rng.integers(0, 12, 5)]
        go, final, letter, role, row, cut = least_paths(codes, np.array([END] * 5), np.ones(5, bool))
        for b, c in enumerate(codes):
            rows = [((" ", "system", "user", "assistant")[x % 4], ("One %d.", "", "", "cut %d")[x // 4]) for x in c.tolist()]
            rows = [(r, t % i if "%" in t else t) for i, (r, t) in enumerate(rows)]
            cost, audit, _ = plain_repair([(r, t if x // 4 not in (1, 2) else "") for (r, t), x in zip(rows, c.tolist())])
            assert int(go[b, 0]) == cost and "".join(LETTERS[x] for x in letter[cut[4 * b] : cut[4 * b + 1]]) == audit
            assert final[b, 0] in (0, 3)


@pytest.mark.parametrize("block", [1024, 3])
def test_repair_against_a_search(spark, monkeypatch, block):
    """Also in blocks of three rows, so that every conversation is put together from many."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    talks = {k: talk(rng, rng.randrange(0, 30) if k else 150) for k in range(40)}
    rows = [(k, i, *x) for k, t in talks.items() for i, x in enumerate(t)]
    rng.shuffle(rows)
    done = repair(spark.createDataFrame(rows, SHAPE).withColumn("conv", conversations.F.lit(1)))
    sums = {r.conv.id: r.sha256 for r in streamed_sha256(done.rows).collect()}
    got = {r.conv.id: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sums.get(r.conv.id, hashlib.sha256(b"").hexdigest())) for r in done.report.collect()}
    assert got == {k: report_of(t) for k, t in talks.items() if t}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    want = con.execute(OP13_SQL).fetchall()
    names = [c[0] for c in con.description]
    got = op13_conversation_repair(spark, f"/root/testdata/{sf}")
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[6] for r in want) > 0


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None), (None, 2, "user", "Hi."), (None, 2, "user", "Hi."), (1, None, "user", "x" * 100_000), (1, 5, "assistant", "é!"), (1, 5, "assistant", None), (1, 9, None, "Yes."), (2, 3, "user", ""), (3, 1, "user", "a."), (3, 7, "user", "a."), (3, 7, "user", "a.")]
    rows += [(k, 0, "user", "Only one?") for k in range(10, 60)]
    spark.createDataFrame(rows, SHAPE).selectExpr("*", "7 AS conv", "8 AS code", "9 AS k", "1 AS at").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{tmp_path}/conversations.parquet/*.parquet'")
    key = lambda r: (r[0] is None, *map(str, r))
    got = sorted(map(tuple, op13_conversation_repair(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(con.execute(OP13_SQL).fetchall(), key=key)
    dropped = [r for r in got if r[0] is not None and r[0] >= 10 and r[7] == ""]
    assert dropped and all(r[1:7] == (0,) * 6 and r[8] == hashlib.sha256(b"").hexdigest() for r in dropped)


def test_empty_table(spark):
    done = repair(spark.createDataFrame([], SHAPE))
    assert done.report.count() == 0 and done.rows.count() == 0 and streamed_sha256(done.rows).count() == 0
