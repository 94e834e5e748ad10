import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import darts, graphs, quality, walks
from geoloom.plans import ordered
from geoloom.plans.fixtures import stacked

HALF, EDGES, COSTS = "gid long, tail long, head long, pos double", "gid long, u long, v long", "gid long, v long, cost double"


def by_place(place, edges):
    """Half-edges of straight lines, clockwise."""
    return [(a, b, -math.atan2(place[b][1] - place[a][1], place[b][0] - place[a][0])) for e in edges for a, b in (e, e[::-1])]


def stack(rng, n):
    place, edges, faces = {0: (0, 0), 1: (1, 0), 2: (0, 1)}, [(0, 1), (1, 2), (0, 2)], [(0, 1, 2)]
    for i in range(3, n):
        a, b, c = faces.pop(rng.randrange(len(faces)))
        w = [rng.uniform(0.2, 1) for _ in range(3)]
        place[i] = tuple(sum(x * place[k][d] for x, k in zip(w, (a, b, c))) / sum(w) for d in (0, 1))
        edges += [(a, i), (b, i), (c, i)]
        faces += [(a, b, i), (b, c, i), (a, c, i)]
    return place, edges


def double_wheel(m):
    half = []
    for i in range(m):
        half += [(i, m + 1, 0), (i, (i - 1) % m, 1), (i, m, 2), (i, (i + 1) % m, 3), (m, i, -i), (m + 1, i, i)]
    return half


def grid(r, c):
    place = {i * c + j: (j, -i) for i in range(r) for j in range(c)}
    edges = [(v, v + d) for v in place for d in (1, c) if v + d in place and (d == c or v % c < c - 1)]
    return place, edges


def graph_cases():
    rng = random.Random(8)
    cases = {"double wheel": double_wheel(320), "small double wheel": double_wheel(5)}
    for n in (300, 420):
        cases[f"stacked {n}"] = by_place(*stack(rng, n))
    place, edges = stack(rng, 500)
    cases["random planar"] = by_place(place, [e for e in edges if rng.random() < 0.6])
    cases["sparse"] = by_place(place, [e for e in edges if rng.random() < 0.4])
    cases["grid"] = by_place(*grid(18, 20))
    cases["path"] = by_place({i: (i, 0) for i in range(50)}, [(i, i + 1) for i in range(49)])
    cases["star"] = by_place({i: (math.cos(i), math.sin(i)) for i in range(1, 40)} | {0: (0, 0)}, [(0, i) for i in range(1, 40)])
    cases["two"] = [(0, 1, 0.0), (1, 0, 0.0)]
    cases["three"] = by_place({0: (0, 0), 1: (1, 0), 2: (2, 0)}, [(0, 1), (1, 2)])
    cases["triangle"] = by_place({0: (0, 0), 1: (1, 0), 2: (0, 1)}, [(0, 1), (1, 2), (0, 2)])
    return cases


def tables(spark, shuffled=True):
    rng = random.Random(2)
    half, costs = [], []
    for gid, rows in enumerate(graph_cases().values()):
        ids = sorted({r[0] for r in rows})
        to = dict(zip(ids, rng.sample(range(10 * len(ids)), len(ids)))) if shuffled else {i: i for i in ids}
        half += [(gid, to[a], to[b], float(p)) for a, b, p in rows]
        costs += [(gid, to[i], 1.0 if gid % 2 else float(rng.choice([0, 1, 2, 50]))) for i in ids]
    h = spark.createDataFrame(half, HALF)
    return spark.createDataFrame(costs, COSTS), h.where("tail < head").select("gid", F.col("tail").alias("u"), F.col("head").alias("v")), h


def test_separators_keep_their_bound(spark):
    v, e, half = tables(spark)
    parts = graphs.find_separator(v, e, half=half).cache()
    flags = {r.gid: r for r in quality.check_balance(parts, v).collect()}
    names = list(graph_cases())
    assert len(flags) == len(names)
    assert not [names[g] for g, r in flags.items() if not (r.a_ok and r.b_ok and r.c_ok)]
    assert quality.check_cross_edges(parts, e).count() == 0 and quality.check_partition(parts, v).count() == 0


def test_triangulated_graphs_keep_eulers_formula(spark):
    """Every face has three sides, and faces = edges - vertices + 2 in each connected graph."""
    v, _, half = tables(spark)
    whole = graphs.components(v, half.select("gid", F.col("tail").alias("u"), F.col("head").alias("v")))
    one = whole.groupBy("gid").agg(F.count_distinct("component").alias("parts"), F.count("*").alias("n")).where("parts = 1 and n >= 3")
    d = darts.triangulated(darts.darts_of(half).join(one, "gid", "left_semi")).cache()
    f = darts.dart_faces(darts.around(d))
    assert f.where("size <> 3").count() == 0
    sums = f.groupBy("gid").agg(F.count_distinct("face").alias("faces"), (F.count("*") / 2).alias("edges")).join(one, "gid")
    assert sums.count() >= 9 and sums.where("faces <> edges - n + 2 or edges <> 3 * n - 6").count() == 0


def test_shrinking_keeps_the_rotation(spark):
    """Levels around the root become one vertex: still an embedding, with the neighbours of the merged vertices."""
    v, e, half = tables(spark)
    levels = graphs.bfs(v, e).cache()
    inside = levels.where("level <= 1").select("gid", "v")
    tree = levels.where("level <= 1").select("gid", "v", "parent")
    kept, d = darts.shrink_embedded(v, darts.darts_of(half), inside, tree)
    d = d.cache()
    want_v, want_e = graphs.shrink(v, e, inside)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want_v.collect()))
    edges = d.where("tail < head").select("gid", "tail", "head")
    assert sorted(map(tuple, edges.collect())) == sorted((r.gid, r.u, r.v) for r in want_e.collect())
    sums = darts.dart_faces(darts.around(d)).groupBy("gid").agg(F.count_distinct("face").alias("faces"), (F.count("*") / 2).alias("edges"))
    parts = graphs.components(kept, edges.toDF("gid", "u", "v")).join(d.select("gid", F.col("tail").alias("v")).distinct(), ["gid", "v"], "left_semi").groupBy("gid").agg(F.count_distinct("component").alias("parts"), F.count("*").alias("n"))
    both = sums.join(parts, "gid")
    assert both.count() >= 8 and both.where("faces <> edges - n + 2 * parts").count() == 0


def spliced(rows):
    """The rotation that putting edges in one by one gives."""
    around = {}
    for e, u, v, after_u, after_v in rows:
        for s, (x, after) in enumerate(((u, after_u), (v, after_v))):
            ring = around.setdefault(x, [])
            at = ring.index((after, 0) if (after, 0) in ring else (after, 1)) if after is not None else len(ring) - 1
            ring.insert(at + 1, (e, s))
    return around


def test_insertion_after_a_named_edge(spark):
    """Multigraphs with parallel edges and loops: the rotation is that of one insertion after the other; faces follow Euler where it is plane."""
    rng = random.Random(4)
    rows, want = [], {}
    for gid in range(12):
        put, ends = [], {}
        for e in range(rng.choice([1, 5, 60])):
            u, v = rng.randrange(6), rng.randrange(6)
            pick = lambda x: rng.choice([None, *ends.get(x, [])])  # noqa: B023, E731
            put.append((e, u, v, pick(u), pick(v)))
            for x in {u, v}:
                ends.setdefault(x, []).append(e)
        rows += [(gid, *p) for p in put]
        for x, ring in spliced(put).items():
            want[gid, x] = ring
    d = darts.inserted(spark.createDataFrame(rows, "gid long, e long, u long, v long, after_u long, after_v long"))
    got = {}
    for r in d.orderBy("pos").collect():
        got.setdefault((r.gid, r.tail), []).append((r.d.a, r.d.s))
    assert got == want


def test_faces_of_plane_multigraphs(spark):
    """A cycle of k vertices whose edges are doubled, with a loop at each vertex: faces = edges - vertices + 2, k of them of one side."""
    rows = [(0, 0, 0, 0, None, 0)]
    for gid in (2, 3, 20):
        k = gid
        rows += [(gid, i, i, (i + 1) % k, None, None) for i in range(k)]
        # the second edge lies on one side of the first: behind it at one end, in front of it at the other
        rows += [(gid, k + i, i, (i + 1) % k, i, (i + 1) % k if i < k - 1 else k) for i in range(k)]
        rows += [(gid, 2 * k + i, i, i, None, 2 * k + i) for i in range(k)]
    d = darts.inserted(spark.createDataFrame(rows, "gid long, e long, u long, v long, after_u long, after_v long"))
    f = darts.dart_faces(darts.around(d)).where("pos = 0").groupBy("gid").agg(F.count("*").alias("faces"), F.count(F.when(F.col("size") == 1, 1)).alias("one"))
    assert {r.gid: (r.faces, r.one) for r in f.collect()} == {0: (2, 2), 2: (6, 2), 3: (8, 3), 20: (42, 20)}


def test_insertion_names_an_end_that_is_there(spark):
    rows = [(1, 0, 1, 2, None, None), (1, 1, 3, 4, 0, None)]
    with pytest.raises(ValueError):
        darts.inserted(spark.createDataFrame(rows, "gid long, e long, u long, v long, after_u long, after_v long"))


def test_long_paths(spark):
    """A path of 100,000 vertices is one of about 17 rounds; more levels than asked for are an error."""
    n = 100_000
    tree = spark.range(n).select(F.lit(1).cast("long").alias("gid"), F.col("id").alias("v"), F.col("id").alias("level"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    pairs = spark.createDataFrame([(1, 1, n - 1, 0), (1, 2, 70, 90), (1, 3, 5, 5)], "gid long, pair long, u long, v long")
    got = {r.pair: (r.n, r.low, r.high) for r in walks.tree_path(pairs, tree).groupBy("pair").agg(F.count("*").alias("n"), F.min("vertex").alias("low"), F.max("vertex").alias("high")).collect()}
    assert got == {1: (n, 0, n - 1), 2: (21, 70, 90), 3: (1, 5, 5)}
    with pytest.raises(RuntimeError):
        walks.tree_path(pairs, tree, most=4)
    few = spark.range(12).select(F.lit(1).cast("long").alias("gid"), F.col("id").alias("v"), F.lit(1.0).alias("cost"))
    line = spark.range(11).select(F.lit(1).cast("long").alias("gid"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    with pytest.raises(RuntimeError):
        graphs.bfs(few, line, most=4)
    assert graphs.bfs(few, line, most=12).count() == 12


def test_paths_in_forests(spark):
    rng = random.Random(6)
    up = {1: {0: None}, 2: {0: None}}
    for k in range(1, 60):
        for g in up:
            up[g][k] = rng.randrange(max(0, k - 4), k) if k != 30 else None
    level = {}
    for g, t in up.items():
        for x in t:
            level[g, x] = 0 if t[x] is None else level[g, t[x]] + 1
    tree = spark.createDataFrame([(g, x, level[g, x], p) for g, t in up.items() for x, p in t.items()], "gid long, v long, level long, parent long")
    pairs = [(g, k, rng.randrange(60), rng.randrange(60)) for k in range(40) for g in up]

    def climb(g, x):
        out = [x]
        while up[g][out[-1]] is not None:
            out.append(up[g][out[-1]])
        return out

    want = {}
    for g, k, u, v in pairs:
        p, q = climb(g, u), climb(g, v)
        if p[-1] == q[-1]:
            top = next(x for x in p if x in q)
            want[g, k] = set(p[: p.index(top) + 1] + q[: q.index(top)])
    got = {}
    for r in walks.tree_path(spark.createDataFrame(pairs, "gid long, pair long, u long, v long"), tree).collect():
        assert r.vertex not in got.setdefault((r.gid, r.pair), set())
        got[r.gid, r.pair].add(r.vertex)
    assert got == want


@pytest.mark.parametrize("around", [True, False])
def test_slices_give_what_windows_give(spark, around):
    from pyspark.sql import Window

    rng = random.Random(9)
    rows = [(k, i, rng.randrange(100)) for k, n in ((1, 3000), (2, 1), (3, 2), (4, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, x long").repartition(7)
    w = Window.partitionBy("k").orderBy("x", "i")
    f = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev, then = F.lag("i").over(w), F.lead("i").over(w)
    if around:
        prev, then = F.coalesce(prev, F.last("i").over(f)), F.coalesce(then, F.first("i").over(f))
    order = [F.col("x"), F.col("i")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several slices for one key
    try:
        got = ordered.neighbours(df, ["k"], order, ["i"], around).collect()
        sums = ordered.running(df, ["k"], order, {"s": F.col("x")}).collect()
        ranks = ordered.ranks(df, ["k"], order, "rk").collect()
        assert ordered.sliced(df, ["k"], order).where("k = 1").select(ordered.SLICE).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, df.select("*", prev, then).collect()), key=str)
    assert sorted(map(tuple, sums)) == sorted(map(tuple, df.select("*", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))).collect()))
    assert sorted(map(tuple, ranks)) == sorted(map(tuple, df.select("*", F.row_number().over(w)).collect()))


def test_stacked_fixture_is_a_triangulation(spark):
    v, e, half = stacked(spark, "/root/testdata/sf0.001")
    n = v.count()
    assert e.count() == 3 * n - 6
    assert darts.dart_faces(darts.around(darts.darts_of(half))).groupBy("size").count().collect() == [(3, 3 * (2 * n - 4))]


def laminar(rng, lo, hi, depth, out):
    """Ranges nested in each other or apart, some with shared ends."""
    if depth == 0 or hi < lo:
        return
    at = lo
    while at <= hi:
        end = rng.randint(at, hi)
        if rng.random() < 0.7:
            out.append((at, end))
            laminar(rng, at, end, depth - 1, out)
        at = end + rng.choice([0, 1])
        if at == end and (at == hi or rng.random() < 0.5):
            at += 1


@pytest.mark.parametrize("seed", [1, 2])
def test_innermost_range(spark, seed):
    from geoloom.operators.nesting import innermost

    rng = random.Random(seed)
    ranges, asked = [], []
    for key in range(4):
        own = []
        laminar(rng, 0, 60, 6, own)
        own += [(100 + i, 300 - i) for i in range(50)] if key == 0 else []
        own = list(dict.fromkeys(own))
        ranges += [(key, i, a, b) for i, (a, b) in enumerate(own)]
        ends = sorted({x for r in own for x in r} | {-1, 400})
        # what is asked lies between neighbouring ends
        asked += [(key, i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:]))] + [(key, 1000 + i, a + 0.25, a + 0.5) for i, a in enumerate(ends)]
    asked = [(k, i, float(a), float(b)) for k, i, a, b in asked]
    ranges = [(k, i, float(a), float(b)) for k, i, a, b in ranges]

    def around(key, a, b, own=None):
        over = [(hi - lo, i) for k, i, lo, hi in ranges if k == key and i != own and lo < hi and lo <= a and b <= hi and a < hi and (hi - lo > b - a or own is None)]
        return min(over)[1] if over else None

    outer, inner = innermost(spark.createDataFrame(ranges, "k long, range_id long, lo double, hi double"), spark.createDataFrame(asked, "k long, ask_id long, lo double, hi double"), ["k"])
    assert {(r.k, r.range_id): r.outer for r in outer.collect()} == {(k, i): around(k, a, b, i) for k, i, a, b in ranges}
    assert {(r.k, r.ask_id): r.range_id for r in inner.collect()} == {(k, i): around(k, a, b) for k, i, a, b in asked}


def test_giant_ring_is_many_tasks(spark):
    """One ring of 300,000 vertices: ranks and neighbours come from slices of a bounded share, and equal those of one window."""
    from pyspark.sql import Window

    from geoloom.operators import rings

    n = 300_000
    v = spark.range(n).select(F.lit(1).cast("long").alias("pid"), F.col("id").alias("idx"), (F.col("id") % 1009).cast("double").alias("x"), (F.col("id") * 7919 % 50_021).cast("double").alias("y")).repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        share = ordered.sliced(v, ["pid"], [F.col("y"), F.col("x"), F.col("idx")]).groupBy(ordered.SLICE).count().agg(F.max("count")).first()[0]
        assert share < n / 3
        got = rings.ring(v, ranged=True).select("idx", "rk", "prev_idx", "next_idx", "prev_rk", "next_rk", "n")
        want = rings.ring(v).select(*got.columns)
        assert got.count() == n and got.exceptAll(want.withColumn("rk", F.col("rk").cast("long"))).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_heights_on_arcs_of_several_edges(spark):
    """An arc over edges 2 to 4 begins in the middle of edge 2 and ends in that of edge 4; others hold the rest of these edges."""
    from geoloom.operators import regions, visibility

    arcs = spark.createDataFrame([(1, 10, 0, 2, 4, "L", "L", 3.0, 7.0), (1, 11, 1, 2, 2, "L", "L", 1.0, 3.0), (1, 12, 2, 4, 4, "L", "L", 7.0, 9.0)], "map_id long, arc_id long, region_id long, first_edge long, last_edge long, first_side string, last_side string, y_first double, y_last double")
    ends = spark.createDataFrame([(1, 2, 1.0, 5.0), (1, 3, 5.0, 6.0), (1, 4, 6.0, 9.0)], "map_id long, edge long, y_start double, y_end double")
    asked = spark.createDataFrame([(1, 0, 2, 2.0), (1, 1, 2, 4.0), (1, 2, 3, 5.5), (1, 3, 4, 8.0), (1, 4, 4, 6.5), (1, 5, 2, 3.0), (1, 6, 9, 1.0), (1, 7, 2, None)], "map_id long, query_id long, e long, y double")
    got = {}
    for r in regions.locate_on_arcs(asked, arcs, ends).collect():
        got.setdefault(r.query_id, set()).add(r.arc_id)
    assert got == {0: {11}, 1: {10}, 2: {10}, 3: {12}, 4: {10}, 5: {10, 11}, 7: {10, 11}}
    one = visibility.region_locate_on_edge(asked.withColumn("side", F.lit("L")), arcs, ends)
    assert {r.query_id: r.region for r in one.collect()} == {0: 1, 1: 0, 2: 0, 3: 2, 4: 0, 5: 0, 6: None, 7: 0}


def test_corners_of_all_chains_at_once():
    """The stack passes of a batch, step by step together, against one after the other."""
    import pyarrow as pa

    from geoloom.operators.triangulation import _cut_ears

    def plain(chain):
        stack, found = [], []
        for v in chain:
            while len(stack) > 1:
                a, b = stack[-2], stack[-1]
                if (b["x"] - a["x"]) * (v["y"] - a["y"]) - (b["y"] - a["y"]) * (v["x"] - a["x"]) < 0:
                    break
                found.append({"a": a["idx"], "b": b["idx"], "c": v["idx"]})
                stack.pop()
            stack.append(v)
        return found

    rng = random.Random(1)
    chains = [[{"k": i, "idx": rng.randrange(1000), "x": float(rng.randint(0, 9)), "y": float(-i)} for i in range(rng.randrange(0, 40))] for _ in range(300)]
    kind = pa.list_(pa.struct([("k", pa.int64()), ("idx", pa.int64()), ("x", pa.float64()), ("y", pa.float64())]))
    got = _cut_ears(pa.array(chains, kind))
    assert got.to_pylist() == [plain(c) for c in chains]
    assert _cut_ears(pa.array(chains, kind).slice(50, 9)).to_pylist() == [plain(c) for c in chains[50:59]]


@pytest.mark.parametrize("few", [0, 20, 10**6])
def test_ranges_of_few_and_many(spark, few):
    """Pairs of points and ranges, by blocks, by plain joins, and by both."""
    from geoloom.operators.chains import holding

    rng = random.Random(few)
    points = [(rng.randint(0, 3), k, rng.randint(-5, 700)) for k in range(150)] + [(0, 900, 2**45), (1, 901, None)]
    ranges = [(rng.choice([0, 0, 0, 1, 2, 4]), k, a, a + rng.choice([-1, 0, 1, 7, 8, 9, 63, 64, 500])) for k, a in enumerate(rng.choices(range(-9, 700), k=90))] + [(0, 900, 0, 2**46), (1, 901, None, 5)]
    p, r = spark.createDataFrame(points, "k long, i long, x long"), spark.createDataFrame(ranges, "k long, j long, a long, b long")
    got = sorted((g.i, g.j) for g in holding(p, r, ["k"], F.col("x"), F.col("a"), F.col("b"), few=few).collect())
    assert got == sorted((i, j) for k, i, x in points for m, j, a, b in ranges if k == m and None not in (x, a) and a <= x <= b)
