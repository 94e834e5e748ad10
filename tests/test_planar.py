"""Small polygons and graphs with known answers, and the queries against their SQL."""

import glob
import math
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from geoloom import queries as planar
from geoloom.operators import chains, graphs, quality, regions, rings, triangulation, visibility
from geoloom.sources import tables

SF = "/root/testdata/sf0.001"
POLYGONS = {
    "triangle": [(0, 0), (4, 0), (2, 3)],
    "square": [(0, 0), (4, 0), (4, 4), (0, 4)],
    "pentagon": [(4, 0), (5, 2), (2.5, 4), (0, 2), (1, 0)],
    "hexagon": [(2, 0), (4, 1), (4, 3), (2, 4), (0, 3), (0, 1)],
    "L": [(0, 0), (2, 0), (2, 2), (4, 2), (4, 4), (0, 4)],
    "arrow": [(0, 4), (0, 0), (4, 0), (2, 2), (4, 4)],
    "clockwise": [(0, 4), (4, 4), (4, 0), (0, 0)],
    **{f"gon{n}": [(10 * math.cos(2 * math.pi * k / n), 10 * math.sin(2 * math.pi * k / n)) for k in range(n)] for n in (7, 8, 12, 50)},
    "star": [((3 if k % 2 == 0 else 1.2) * math.cos(math.pi * k / 5), (3 if k % 2 == 0 else 1.2) * math.sin(math.pi * k / 5)) for k in range(10)],
}


def star_shaped(count, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        n = rng.randint(5, 30)
        r = [rng.randint(2, 40) for _ in range(n)]
        out.append([(r[i] * math.cos(2 * math.pi * i / n), r[i] * math.sin(2 * math.pi * i / n)) for i in range(n)])
    return out


@pytest.fixture(scope="module")
def vertices(spark):
    every = [*POLYGONS.values(), *star_shaped(40, 7)]
    return spark.createDataFrame([(p, i, float(x), float(y)) for p, c in enumerate(every) for i, (x, y) in enumerate(c)], "pid long, idx long, x double, y double")


def test_triangulation_of_small_and_random_polygons(spark, vertices):
    t = triangulation.triangulate(vertices).cache()
    assert quality.check_count(t, vertices).count() == 0
    assert quality.check_triangle_ids(t, vertices).count() == 0
    assert quality.check_edge_use(t).count() == 0
    assert quality.check_coverage(t, vertices).count() == 0
    for r in quality.check_area(t, rings.orient_ccw(vertices)).collect():
        assert math.isclose(r.area2, r.triangles2, rel_tol=1e-9)


def test_trapezoids_are_one_less_than_vertices(vertices):
    v = rings.orient_ccw(vertices)
    for small in (2000, 0):
        n = visibility.trapezoids(v, small).groupBy("pid").count().withColumnRenamed("count", "traps")
        assert v.groupBy("pid").agg(F.count("*").alias("n")).join(n, "pid").where("traps <> n - 1").count() == 0


def test_long_chains_are_split(spark):
    rng = random.Random(3)
    roof = [(float(k), float(rng.randint(1, 1000))) for k in range(300)]
    v = spark.createDataFrame([(0, i, x, y) for i, (y, x) in enumerate([(0.0, 0.0), *roof[1:-1], (299.0, 0.0)])], "pid long, idx long, x double, y double")
    p = rings.orient_ccw(v).withColumn("piece", F.lit(0)).withColumn("pos", F.col("idx"))
    t = triangulation.triangulate_monotone(p, small=10)
    assert t.count() == 298
    row = quality.check_area(t, rings.orient_ccw(v)).collect()[0]
    assert math.isclose(row.area2, row.triangles2, rel_tol=1e-9)


@pytest.mark.parametrize("n,size", [(3, 3), (4, 5), (5, 5), (6, 9), (9, 9)])
def test_padding(spark, n, size):
    v = spark.createDataFrame([(0, k, float(k), float(k * k)) for k in range(n)], "pid long, idx long, x double, y double")
    got = sorted(r.idx for r in rings.pad_ring(v).collect())
    assert got == list(range(size))


def test_dyadic_cuts_against_the_greedy_rule(spark):
    def greedy(s, e, top):
        while s < e:
            k = 0
            while k < top and s % 2 ** (k + 1) == 0 and s + 2 ** (k + 1) <= e:
                k += 1
            yield s, s + 2**k
            s += 2**k

    ranges = [(s * 100 + e, s, e) for s in range(0, 40, 3) for e in range(0, 64, 5)]
    for top in (62, 2):
        got = {}
        for r in chains.dyadic_cut(spark.createDataFrame(ranges, "range_id long, s long, e long"), top).collect():
            got.setdefault(r.range_id, []).append((r.start, r.end))
        for i, s, e in ranges:
            assert sorted(got.get(i, [])) == list(greedy(s, e, top))


def grid(spark, rows, cols):
    v = [(0, r * cols + c, 1.0) for r in range(rows) for c in range(cols)]
    e = [(0, a, b) for _, a, _ in v for b in ((a + 1,) if a % cols < cols - 1 else ()) + ((a + cols,) if a + cols < rows * cols else ())]
    return spark.createDataFrame(v, "gid long, v long, cost double"), spark.createDataFrame(e, "gid long, u long, v long")


def test_separators_of_cycle_and_grid(spark):
    cycle = spark.createDataFrame([(1, k, 1.0) for k in range(12)], "gid long, v long, cost double"), spark.createDataFrame([(1, k, (k + 1) % 12) for k in range(12)], "gid long, u long, v long")
    g = grid(spark, 5, 5)
    v, e = g[0].unionByName(cycle[0]), g[1].unionByName(cycle[1])
    parts = graphs.find_separator(v, e).cache()
    assert all(r.a_ok and r.b_ok and r.c_ok for r in quality.check_balance(parts, v).collect())
    assert quality.check_cross_edges(parts, e).count() == 0 and quality.check_partition(parts, v).count() == 0
    pieces = graphs.iterated_separator(*grid(spark, 6, 6), 8).cache()
    assert all(r.size_ok and r.all_ok and r.ids_ok for r in quality.check_pieces(pieces, grid(spark, 6, 6)[0], 8).collect())


def test_separators_of_hubs_and_triangulated_grids_beside_others(spark):
    """A wheel (hub 0), a triangulated grid, single vertices and an empty hub graph in one table: none stops the others."""
    v = [(1, k, 1.0) for k in range(41)] + [(2, k, 1.0) for k in range(49)] + [(3, 0, 1.0)] + [(4, k, 1.0) for k in range(30)]
    e = [(1, 0, k) for k in range(1, 41)] + [(1, k, k % 40 + 1) for k in range(1, 41)]
    e += [(2, a, a + b) for a in range(49) for b in (1, 7, 8) if a + b < 49 and not (b in (1, 8) and a % 7 == 6)]
    e += [(4, 0, k) for k in range(1, 30)]
    gv, ge = spark.createDataFrame(v, "gid long, v long, cost double"), spark.createDataFrame(e, "gid long, u long, v long")
    parts = graphs.find_separator(gv, ge).cache()
    flags = {r.gid: r for r in quality.check_balance(parts, gv).collect()}
    assert all(flags[g].a_ok and flags[g].b_ok and flags[g].c_ok for g in (1, 2, 4))
    assert quality.check_cross_edges(parts, ge).count() == 0 and quality.check_partition(parts, gv).count() == 0


def test_gluing_of_arcs_at_ends_that_vanish(spark):
    """Two regions meet in a chord with ends on edges 4 and 9. Arcs glue at 4 alone: 9 is still used by another chord, or is a vertex."""
    regions_ = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "map_id long, region_id long")
    arcs = spark.createDataFrame([(0, 0, 0, 0, 4, "L", "L", 5), (0, 1, 1, 4, 9, "L", "L", 6), (0, 2, 0, 9, 12, "L", "L", 4), (0, 3, 2, 12, 14, "L", "L", 3)], "map_id long, arc_id long, region_id long, first_edge long, last_edge long, first_side string, last_side string, edge_count long")
    chords = spark.createDataFrame([(0, 0, 0, 1, 4, 9, 2.0, False), (0, 1, 0, 2, 9, 12, 5.0, False)], "map_id long, chord_id long, region_a long, region_b long, left_edge long, right_edge long, y double, is_null_length boolean")
    drop = chords.where("chord_id = 0").select("map_id", "chord_id")
    glued = lambda c, h=None: sorted((r.arc_id, r.first_edge, r.last_edge, r.edge_count) for r in regions.contract_chords(regions_, arcs, c, drop, heights=h)[1].collect())
    assert glued(chords) == [(0, 0, 9, 11), (2, 9, 12, 4), (3, 12, 14, 3)]
    assert glued(chords.where("chord_id = 0")) == [(0, 0, 12, 15), (3, 12, 14, 3)]
    vertex = spark.createDataFrame([(0, 4, 2.0), (0, 4, 3.0)], "map_id long, edge long, y double")
    assert glued(chords, vertex) == [(0, 0, 4, 5), (1, 4, 9, 6), (2, 9, 12, 4), (3, 12, 14, 3)]
    merged = {r.chord_id: r.merged for r in regions.merged_weights(regions_, arcs, chords).collect()}
    assert merged == {0: 11, 1: 7}


def test_range_joins_by_pieces_equal_those_by_polygon(spark, vertices):
    v = rings.orient_ccw(vertices)
    rays = v.select("pid", F.col("idx").alias("ray_id"), (F.col("x") + 0.1).alias("x"), (F.col("y") * 0.5).alias("y"))
    a, b = (visibility.shoot_from_point(rays, v, small) for small in (2000, 0))
    assert a.count() == rays.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ranges_that_hold_points(spark):
    rng = random.Random(5)
    points = [(rng.randint(0, 2), k, rng.randint(-5, 700)) for k in range(200)] + [(0, 900, 2**45), (1, 901, None)]
    ranges = [(rng.randint(0, 2), k, a, a + rng.choice([-1, 0, 1, 7, 8, 9, 63, 64, 500])) for k, a in enumerate(rng.choices(range(-9, 700), k=200))] + [(0, 900, 0, 2**46), (1, 901, None, 5)]
    p, r = spark.createDataFrame(points, "k long, i long, x long"), spark.createDataFrame(ranges, "k long, j long, a long, b long")
    got = sorted((g.i, g.j) for g in chains.holding(p, r, ["k"], F.col("x"), F.col("a"), F.col("b")).collect())
    assert got == sorted((i, j) for k, i, x in points for m, j, a, b in ranges if k == m and None not in (x, a) and a <= x <= b)


def test_cycle_costs_against_winding(spark):
    """A triangulated 5 x 6 grid and a tree, with uneven costs: each cycle's sides by the polygon that it is."""
    cols, rows = 6, 5
    place = {v: (v % cols, -(v // cols)) for v in range(rows * cols)}
    edges = [(a, a + b) for a in place for b in (1, cols, cols + 1) if a + b in place and not (b != cols and a % cols == cols - 1)]
    cost = {v: float(1 + v * 7 % 5) for v in place}
    half = [(1, a, b, -math.atan2(place[b][1] - place[a][1], place[b][0] - place[a][0])) for e in edges for a, b in (e, e[::-1])]
    half += [(2, 0, 1, 0.0), (2, 1, 0, 0.0)]
    gv = spark.createDataFrame([(1, k, c) for k, c in cost.items()] + [(2, 0, 1.0), (2, 1, 1.0)], "gid long, v long, cost double")
    gh = spark.createDataFrame(half, "gid long, tail long, head long, pos double")
    tree = graphs.bfs(gv, gh.select("gid", F.col("tail").alias("u"), F.col("head").alias("v")).where("u < v")).cache()
    up = {r.v: r.parent for r in tree.where("gid = 1").collect()}

    def path(x):
        out = [x]
        while up[out[-1]] is not None:
            out.append(up[out[-1]])
        return out

    want = {}
    for a, b in edges:
        if up[a] != b and up[b] != a:
            p, q = path(a), path(b)
            top = next(x for x in p if x in q)
            ring = p[: p.index(top) + 1] + q[: q.index(top)][::-1]
            side = {True: 0.0, False: 0.0}
            for x in set(place) - set(ring):
                turns = sum(math.remainder(math.atan2(place[d][1] - place[x][1], place[d][0] - place[x][0]) - math.atan2(place[c][1] - place[x][1], place[c][0] - place[x][0]), 2 * math.pi) for c, d in zip(ring, ring[1:] + ring[:1]))
                side[abs(turns) > 1] += cost[x]
            want[a, b] = (side[True], side[False], sum(map(cost.get, ring)))
    got = {(r.u, r.v): (r.inside, r.outside, r.on_cycle) for r in graphs.cycle_costs(gv, gh, tree).collect()}
    assert got.keys() == want.keys()
    assert all(sorted(got[e][:2]) == sorted(want[e][:2]) and got[e][2] == want[e][2] for e in want)
    best = graphs.best_cycle(gv, gh, tree).collect()
    assert [r.gid for r in best] == [1] and best[0].larger == min(max(w[:2]) for w in want.values()) and 3 * best[0].larger <= 2 * sum(cost.values())


def test_reading_polygon_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3\n0 0\n4 0\n2 3\n")
    (tmp_path / "b.txt").write_text("2\n0 0\n1 1\n")
    (tmp_path / "c.txt").write_text("4\n0 0\n1 1\n2 x\n3 3\n")
    (tmp_path / "d.txt").write_text("3\n0 0\n1 1\n")
    ok, bad = tables.read_polygon_text(spark, str(tmp_path))
    assert [(r.idx, r.x, r.y) for r in ok.orderBy("idx").collect()] == [(0, 0, 0), (1, 4, 0), (2, 2, 3)]
    assert sorted(r.reason for r in bad.collect()) == ["a coordinate is missing", "a coordinate is no number", "fewer than 3 vertices"]
    tables.write_triangles(triangulation.triangulate(ok), str(tmp_path / "out"), text=True)
    assert len(glob.glob(f"{tmp_path}/out/pid=*")) == 1
    tables.write_triangles(triangulation.triangulate(ok), str(tmp_path / "lines"), text=True, folders=False)
    (line,) = [r.value.split() for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert line[0] == str(ok.first().pid) and sorted(line[1:]) == ["0", "1", "2"]


def compare(a, b):
    a, b = a[sorted(a.columns)], b[sorted(b.columns)]
    assert list(a.columns) == list(b.columns)

    def plain(df):
        return sorted(tuple("None" if pd.isna(x) else str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.astype(object).itertuples(index=False))

    assert plain(a) == plain(b)


FAST = [q for q in planar.QUERIES if q in planar.ORACLES and q.split("_")[0] not in ("t4", "g15", "g16", "g21", "m6")]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    compare(planar.QUERIES[name](spark, SF).toPandas(), con.sql(planar.ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
