"""Conversation structure repair: cheapest edits that make the roles of a conversation read (system)? (user assistant)*.

Rows are sorted by conversation and turn in ranges, over all tasks, and cut into blocks of at most BLOCK rows, so that
a conversation of any length is many blocks. The cost DP has a node for each place between rows and each last
role (0 none, 1 system, 2 user, 3 assistant). A block is a 4 x 4 matrix of least costs; products of neighbouring
blocks' matrices, doubled in reach by joins, give the cost to go at the end of each block.

Inside a block nodes are ranked by the edits still to come on optimal arcs: first by one letter, then by two, four and so on,
each round pairing a node's rank with that of the node its pointer reaches, while pointers double. Ranks choose the
least arc of a node, doubled pointers read the path. A letter leads from a node to one node only, so which
arc is least never depends on what lies behind the block; where each of the four ways into a block leaves it is
composed over blocks by doubling once more.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, fresh, ship, written

ship(__name__)

BLOCK = 1024
WHITE_TEXT = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3  # faults; a row's code is its role + 4 * fault
FILL = (2, 2, 3, 2)  # the role that an inserted or changed row gets behind each last role
FOLLOWS = ((1, 2), (2,), (3,), (2,))
END = (0, 6, 3, 0)  # cost of the inserts that end a conversation
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
FAR = 10**9


def row_arcs() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next role of each edit but inserting, by code, last role and letter; FAR where it isn't allowed."""
    cost, then = np.full((16, 4, 4), FAR, np.int64), np.zeros((16, 4, 4), np.int64)
    for code in range(16):
        role, fault = code % 4, code // 4
        for s in range(4):
            cost[code, s, DELETE], then[code, s, DELETE] = 4, s
            if fault in (BLANK, DUPLICATE):
                continue
            more = 3 * (fault == TRUNCATED)
            cost[code, s, REROLE], then[code, s, REROLE] = 3 + more, FILL[s]
            if role in FOLLOWS[s]:
                cost[code, s, KEEP], then[code, s, KEEP] = more, role
    return cost, then


ARC_COST, ARC_THEN = row_arcs()


def row_matrices() -> np.ndarray:
    """Least cost from each last role to each, over a row and the inserts before it."""
    own = np.full((16, 4, 4), FAR, np.int64)
    for code in range(16):
        for s in range(4):
            for x in range(4):
                t = ARC_THEN[code, s, x]
                own[code, s, t] = min(own[code, s, t], ARC_COST[code, s, x])
    one = own[:, FILL]
    return np.minimum(np.minimum(own, one + 3), one[:, FILL] + 6)


ROW = row_matrices()


def matrices(codes: list[np.ndarray]) -> np.ndarray:
    """The matrix of each block of codes, row by row over all of them at once."""
    size = np.array([len(c) for c in codes])
    order = np.argsort(-size, kind="stable")
    out = np.where(np.eye(4, dtype=bool), 0, FAR) * np.ones((len(codes), 1, 1), np.int64)
    for t in range(size.max(initial=0)):
        live = order[: np.searchsorted(-size[order], -t, "left")]
        row = ROW[[codes[k][t] for k in live]]
        out[live] = np.minimum((out[live][:, :, :, None] + row[:, None]).min(2), FAR)
    return out


def sliced(run, codes: pa.Array, *others: pa.Array) -> pa.Array:
    """run over slices of some 50,000 rows of conversations."""
    parts = [run(*(c.slice(i, j - i) for c in (codes, *others))) for i, j in blocks(codes.value_lengths().to_pylist(), 50_000)]
    return pa.concat_arrays(parts or [run(codes, *others)])


def block_matrices(codes: pa.Array) -> pa.Array:
    def run(codes: pa.Array) -> pa.Array:
        return pa.array(matrices([np.array(c, np.int64) for c in codes.to_pylist()]).reshape(-1, 16).tolist(), pa.list_(pa.int64()))

    return sliced(run, codes)


def least_paths(codes: list[np.ndarray], after: np.ndarray, last: np.ndarray):
    """For each block, from each last role at its begin: (cost to go, last role at its end, letters, roles after each letter, rows before each letter).

    after: cost to go at the end of each block; a last block goes on with inserts until the conversation may end."""
    size = np.array([len(c) for c in codes])
    begin = np.concatenate(([0], np.cumsum(size + 1)))  # places of a block: before each row, and its end
    places = begin[-1]
    end = begin[1:] - 1
    code = np.zeros(places, np.int64)
    code[np.delete(np.arange(places), end)] = np.concatenate(codes or [np.zeros(0, np.int64)])
    go = np.zeros((places, 4), np.int64)
    go[end] = after
    order = np.argsort(-size, kind="stable")
    for back in range(1, size.max(initial=0) + 1):
        at = end[order[: np.searchsorted(-size[order], -back, "right")]] - back
        edits = (ARC_COST[code[at]] + go[at[:, None, None] + 1, ARC_THEN[code[at]]]).min(2)
        one = edits[:, FILL]
        go[at] = np.minimum(np.minimum(edits, one + 3), one[:, FILL] + 6)
    # arcs of node 4 * place + last role, by letter
    node = np.arange(places * 4)
    cost, to = ARC_COST[code] + 0, (np.arange(places)[:, None, None] + 1) * 4 + ARC_THEN[code]
    cost[end], to[end] = FAR, 0
    cost[:, :, INSERT], to[:, :, INSERT] = 3, np.arange(places)[:, None] * 4 + np.array(FILL)
    cost[end[~last], :, INSERT] = FAR
    cost, to = cost.reshape(-1, 4), to.reshape(-1, 4)
    best = cost + go.ravel()[to] == go.ravel()[:, None]
    stops = ~best.any(1)
    rank = np.where(stops, 0, best.argmax(1) + 1)
    pointer = np.where(stops, node, to[node, best.argmax(1)])
    deepest = 1
    while deepest < 3 * size.max(initial=0) + 3:  # a row has two inserts before it at most
        _, rank = np.unique(rank * (places * 4 + 5) + rank[pointer], return_inverse=True)
        pointer, deepest = pointer[pointer], deepest * 2
    choice = np.where(best, np.arange(4) * (places * 4 + 5) + rank[to], FAR * (places + 1)).argmin(1)
    pointer, steps = np.where(stops, node, to[node, choice]), (~stops).astype(np.int64)
    doubled = [pointer]
    while (further := steps[doubled[-1]]).any():
        steps = steps + further
        doubled.append(doubled[-1][doubled[-1]])
    start = (begin[:-1, None] * 4 + np.arange(4)).ravel()
    n = steps[start]
    path = np.repeat(start, n)
    nth = np.arange(len(path)) - np.repeat(np.cumsum(n) - n, n)
    for k, p in enumerate(doubled):
        path = np.where(nth >> k & 1, p[path], path)
    final = start
    for p in reversed(doubled):
        final = p[final]
    after_role = np.where(choice[path] == DELETE, 0, pointer[path] % 4)
    row = path // 4 - np.repeat(np.repeat(begin[:-1], 4), n)
    return go[begin[:-1]], final.reshape(-1, 4) % 4, choice[path], after_role, row, np.concatenate(([0], np.cumsum(n)))


WAY = "to_go array<long>, leaves array<int>, ways array<array<struct<edit:string,row:int,role:int>>>"


def block_paths(codes: pa.Array, after: pa.Array, last: pa.Array) -> pa.Array:
    item = pa.struct([("edit", pa.string()), ("row", pa.int32()), ("role", pa.int32())])

    def run(codes: pa.Array, after: pa.Array, last: pa.Array) -> pa.Array:
        codes = [np.array(c, np.int64) for c in codes.to_pylist()]
        go, final, letter, role, row, cut = least_paths(codes, np.array(after.to_pylist(), np.int64).reshape(-1, 4), np.array(last.to_pylist(), bool))
        items = [{"edit": LETTERS[x], "row": i, "role": r} for x, i, r in zip(letter.tolist(), row.tolist(), role.tolist())]
        ways = [[items[cut[4 * b + s] : cut[4 * b + s + 1]] for s in range(4)] for b in range(len(codes))]
        return pa.StructArray.from_arrays([pa.array(go.tolist(), pa.list_(pa.int64())), pa.array(final.tolist(), pa.list_(pa.int32())), pa.array(ways, pa.list_(pa.list_(item)))], ["to_go", "leaves", "ways"])

    return sliced(run, codes, after, last)


def times(a: Column, b: Column) -> Column:
    """Product of two 4 x 4 matrices of least costs, as arrays of 16."""
    cell = lambda x: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get(a, (x - x % 4 + j).cast("int")) + F.get(b, (j * 4 + x % 4).cast("int"))))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.least(cell(x), F.lit(FAR)))


def doubled(state: DataFrame, value: str, longest: int, ahead: bool, combine) -> DataFrame:
    """(conv, k, value) with value combined over all blocks from k to the last (ahead), or from the first to k; a round for each power of two up to the longest."""
    step = 1
    while step < longest:
        shift = F.col("k") - step if ahead else F.col("k") + step
        other = state.select("conv", shift.alias("k"), F.col(value).alias("other"))
        state = written(state.join(other, ["conv", "k"], "left").select("conv", "k", F.when(F.col("other").isNull(), F.col(value)).otherwise(combine(F.col(value), F.col("other"))).alias(value)), "conv-doubled")
        step *= 2
    return state


@dataclass
class Repair:
    """report: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation with rows.
    rows: (conv, place, edit, role, text), the repaired rows in order of place. conv is a struct that holds the id as `id`, null or not."""

    report: DataFrame
    rows: DataFrame


def repair(talks: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Cheapest repairs of all conversations: keep a row 0, give it the role user or assistant 3, delete it 4, insert an empty row 3;
    a truncated row that isn't deleted 3 more. Blank and duplicate rows must go. Of the cheapest, that with the least audit (its edits' letters).

    Rows are taken by turn, null first; rows of one turn by role and the MD5 of the text, so that repeated rows are
    neighbours. A null id is a conversation of its own; a null role or text counts as one space. Roles that don't begin with s, u or a fit nowhere.
    An empty table gives empty frames; columns of other names are left out, whatever they are called."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    rows = talks.select(F.struct(F.col(id_col).alias("id")).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    bare = F.rtrim("text", F.lit(WHITE_TEXT))
    kind = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    first = F.substring("role", 1, 1)
    rows = rows.withColumns({"digest": F.unhex(F.md5(F.encode("text", "UTF-8"))), "fault": kind, "code": F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)})
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())  # numbers in that order, without gaps in a range
    rows = written(rows, "conv-rows")

    seen = rows.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    marked = rows.select("conv", "at", "code", "fault").join(seen, "at", "left")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    marked = marked.select("conv", F.expr(f"at div {BLOCK}").alias("block"), "at", (F.col("code") + 4 * fault).cast("int").alias("code"))
    packed = marked.groupBy("conv", "block").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "code"))).alias("c"))  # BLOCK rows at most
    w = Window.partitionBy("conv").orderBy("block")  # one row for each block
    packed = packed.select("conv", "block", "at", F.col("c.code").alias("codes"))
    packed = packed.withColumns({"k": F.row_number().over(w).cast("long"), "m": F.count("*").over(Window.partitionBy("conv")), "before": F.lag(F.element_at("codes", -1)).over(w)})
    packed = written(packed, "conv-blocks")

    many = packed.where("m > 1")
    longest = many.agg(F.max("m")).first()[0] or 0
    ends = F.array(*[F.lit(x).cast("long") for x in END])
    costs = doubled(written(many.select("conv", "k", F.arrow_udf(block_matrices, "array<long>")("codes").alias("costs")), "conv-matrices"), "costs", longest, True, times)
    to_end = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.get("costs", (s * 4 + t).cast("int")) + F.get(ends, t.cast("int")))))
    after = costs.select("conv", (F.col("k") - 1).alias("k"), to_end.alias("after"))
    found = packed.join(after, ["conv", "k"], "left").withColumn("after", F.coalesce("after", ends)).withColumn("way", F.arrow_udf(block_paths, WAY)("codes", "after", F.col("k") == F.col("m")))
    found = written(found.select("conv", "block", "at", "k", "m", "codes", "before", "way.*"), "conv-ways")

    through = lambda late, early: F.transform(early, lambda s: F.get(late, s))
    reached = doubled(found.where("m > 1").select("conv", "k", "leaves"), "leaves", longest, False, through)
    enters = reached.select("conv", (F.col("k") + 1).alias("k"), F.get("leaves", F.lit(0)).alias("enter"))
    found = found.join(enters, ["conv", "k"], "left").withColumn("enter", F.coalesce("enter", F.lit(0)))
    found = written(found.select("conv", "block", "at", "k", "codes", "before", F.get("to_go", "enter").alias("cost"), F.get("ways", "enter").alias("edits")), "conv-edits")

    faults = lambda f: F.sum(F.size(F.filter("codes", lambda c: F.floor(c / 4) == f))).cast("long")
    roles = F.transform(F.filter(F.concat(F.array("before"), F.col("codes")), lambda c: c.isNotNull()), lambda c: c % 4)
    illegal = F.size(F.filter(F.sequence(F.lit(1), F.size("roles")), lambda i: (i > 1) & ~(F.get("roles", i - 2) * 10 + F.get("roles", i - 1)).isin(12, 23, 32)))
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.array_join("edits.edit", "").alias("part")))), lambda x: x["part"]), "")
    report = found.withColumn("roles", roles).groupBy("conv").agg(faults(BLANK).alias("blank"), faults(DUPLICATE).alias("duplicate"), faults(TRUNCATED).alias("truncated"), F.sum(illegal).cast("long").alias("illegal"), F.min_by("cost", "k").alias("cost"), audit.alias("audit"))
    turns = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    report = turns.join(report, "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    each = found.select("conv", "block", "at", F.posexplode("edits").alias("nth", "e")).where("e.edit <> 'D'")
    each = each.select("conv", (F.col("block") * (4 * BLOCK) + F.col("nth")).alias("place"), "e.edit", "e.role", F.when(F.col("e.edit") != "I", F.col("at") + F.col("e.row")).alias("at"))
    given = F.when(F.col("role") == 2, "user").otherwise("assistant")
    kept = each.where("edit <> 'I'").withColumn("given", given).drop("role").join(rows.select("at", "role", "text"), "at")
    out = kept.select("conv", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("given")).alias("role"), "text")
    return Repair(report, out.unionByName(each.where("edit = 'I'").select("conv", "place", "edit", given.alias("role"), F.lit("").alias("text"))))


def streamed_sha256(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's `role:text` lines in order of place. Lines go through one by one: no conversation is held whole, but its digest is one task's, as SHA-256 can't be parted."""

    def run(batches):
        key, state = None, None
        for b in batches:
            keys, sums = [], []
            for k, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is not None and k == key:
                    state.update(b"\n")
                else:
                    if state is not None:
                        keys.append(key)
                        sums.append(state.hexdigest())
                    key, state = k, hashlib.sha256()
                state.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(sums, pa.string())], ["conv", "sha256"])
            kind = b.schema.field(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], ["conv", "sha256"])

    lines = rows.select("conv", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv").sortWithinPartitions("conv", "place").select("conv", "line")
    kind = rows.schema["conv"].dataType.simpleString()
    return lines.mapInArrow(run, f"conv {kind}, sha256 string")


def damaged(talks: DataFrame) -> DataFrame:
    """Rows as the crc32 of `conv_id:turn` modulo 20 says: 0 dropped, 1 emptied, 2 without [.!?], 3 twice, 4 by the user; nulls read as one space, a null turn stays."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = fresh(talks, "k")
    rows = talks.withColumn(k, F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).where(F.col(k) != 0)
    text = F.when(F.col(k) == 1, "").when(F.col(k) == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.explode(F.when(F.col(k) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col(k) == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), copies.alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = repair(damaged(talks))
    every = talks.select(F.struct(F.col("conv_id").alias("id")).alias("conv")).distinct()
    out = every.join(done.report, "conv", "left").join(streamed_sha256(done.rows), "conv", "left")
    number = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv.id").alias("conv_id"), *number, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP13_SQL = """
WITH RECURSIVE
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
bits AS (SELECT *, flatten(list_transform(range(1, length(name) + 1), lambda i: list_transform(range(8), lambda j: CAST((ascii(name[i]) >> j) & 1 AS BIGINT)))) AS b FROM c),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x >> 1, CASE WHEN xor(x, y) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 20 AS k FROM bits),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc JOIN (VALUES (0), (1)) u(copy) ON copy = 0 OR k = 3 WHERE k <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
  CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS rc FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(rc) OVER (PARTITION BY conv_id ORDER BY i) AS rc0 FROM r),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (rc0 IS NOT NULL AND rc0 * 10 + rc NOT IN (12, 23, 32)) AS illegal FROM f GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS i, [{'c': 0, 'a': ''}, {'c': 6, 'a': 'II'}, {'c': 3, 'a': 'I'}, {'c': 0, 'a': ''}] AS b FROM counts
  UNION ALL
  SELECT conv_id, i, list_transform(e, lambda x, s: list_min([x, {'c': e[[3, 3, 4, 3][s]].c + 3, 'a': 'I' || e[[3, 3, 4, 3][s]].a}, {'c': e[[4, 4, 3, 4][s]].c + 6, 'a': 'II' || e[[4, 4, 3, 4][s]].a}])) FROM (
    SELECT w.conv_id, f.i, list_transform(w.b, lambda x, s: list_min([{'c': x.c + 4, 'a': 'D' || x.a},
      {'c': CASE WHEN fault IN (1, 2) OR s * 10 + rc NOT IN (11, 12, 22, 33, 42) THEN 1000000000 ELSE w.b[rc + 1].c + CASE WHEN fault = 3 THEN 3 ELSE 0 END END, 'a': 'K' || w.b[rc + 1].a},
      {'c': CASE WHEN fault IN (1, 2) THEN 1000000000 ELSE w.b[[3, 3, 4, 3][s]].c + CASE WHEN fault = 3 THEN 6 ELSE 3 END END, 'a': 'R' || w.b[[3, 3, 4, 3][s]].a}])) AS e
    FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1)),
best AS (SELECT conv_id, b[1].c AS cost, b[1].a AS audit FROM walk WHERE i = 0),
l AS (SELECT conv_id, j, audit[j] AS edit, length(replace(left(audit, CAST(j - 1 AS INTEGER)), 'I', '')) AS i, length(replace(left(audit, CAST(j - 1 AS INTEGER)), 'D', '')) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
o AS (SELECT l.*, f.role, f.text, max(CASE WHEN e = 0 AND edit = 'K' AND rc = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS off FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.edit <> 'I' WHERE l.edit <> 'D'),
done AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - off) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM o GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id
"""
