"""Work and memory that grow with the input: plans without pairs, sizes that keep tables off the driver, small graphs walked in place."""

import pytest
from pyspark.sql import functions as F

from geoloom.operators import graphs, quality, regions, triangulation, visibility, walks
from geoloom.plans.fixtures import grid, skylines
from geoloom.plans.iterate import cut

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_rays_of_small_polygons_need_no_pairs(spark):
    v = cut(skylines(spark, SF, "l_suppkey"))
    for closed in (True, False):
        shot = visibility.ray_shoot(v, closed)
        assert "Join" not in shot._jdf.queryExecution().optimizedPlan().toString()
        assert rows(shot) == rows(visibility.ray_shoot(v, closed, small=0))


def test_rays_with_polygons_of_both_sizes(spark):
    v = cut(skylines(spark, SF).unionByName(skylines(spark, SF, "l_suppkey").withColumn("pid", F.col("pid") + 10_000)))
    assert rows(visibility.ray_shoot(v, small=100)) == rows(visibility.ray_shoot(v, small=0))


def test_cut_tables_of_many_rows_are_not_taken_for_small(spark):
    t = cut(spark.range(2_000_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), F.lit(1).cast("long").alias("b")))
    assert t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 10 * 2**20


def test_walks_in_place_and_by_rounds_are_the_same(spark):
    n = 97
    s = spark.range(4 * n).select((F.col("id") % 4).alias("gid"), F.expr("id div 4").alias("i")).select("gid", F.struct(F.expr("i % 2").alias("a"), "i").alias("h"), F.expr(f"(i * (gid + 2)) % {n}").alias("j")).select("gid", "h", F.struct(F.expr("j % 2").alias("a"), F.col("j").alias("i")).alias("next"))
    few = walks.faces(s)
    assert rows(few) == rows(walks.faces(s, small=0)) and few.count() == 4 * n
    both = s.unionByName(s.where("gid = 0").withColumn("gid", F.lit(9).cast("long")))
    assert rows(walks.faces(both, small=50)) == rows(walks.faces(both))


def test_small_graphs_in_place_and_giant_ones_by_rounds_are_the_same(spark):
    v, e = map(cut, grid(spark, "/root/testdata/sf0.01"))
    e = cut(e.where("(u * 7 + v) % 5 > 0"))  # in parts, some vertices alone
    for small in (0, 250, 20_000):
        assert rows(graphs.components(v, e, small=small)) == rows(graphs._contracted(v, e, 60))
    start = v.groupBy("gid").agg(F.min("v").alias("v"))
    levels = rows(graphs._by_levels(cut(graphs.both_ways(e)), start, 1000))
    for small in (0, 250, 20_000):
        assert rows(graphs.bfs(v, e, small=small).select("gid", "v", "level", "parent")) == levels
    with pytest.raises(RuntimeError, match="levels"):
        graphs.bfs(v, e, most=2)


def test_levels_of_small_graphs_take_no_round_each(spark):
    path = cut(spark.range(300).select((F.col("id") % 3).alias("gid"), F.col("id").alias("u"), (F.col("id") + 3).alias("v")))
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("levels", "levels")
    out = graphs.bfs(path.select("gid", F.col("u").alias("v")), path)
    spark.sparkContext.setJobGroup("", "")
    assert len(seen.getJobIdsForGroup("levels")) < 20 and out.agg(F.max("level")).first()[0] == 100


def test_components_of_small_graphs_take_no_rounds(spark):
    path = cut(spark.range(3000).select((F.col("id") % 3).alias("gid"), F.col("id").alias("u"), (F.col("id") + 3).alias("v")))
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("parts", "parts")
    out = graphs.components(path.select("gid", F.col("u").alias("v")), path)
    spark.sparkContext.setJobGroup("", "")
    assert len(seen.getJobIdsForGroup("parts")) < 10 and rows(out.select("gid", "component").distinct()) == rows(spark.range(3).selectExpr("id as gid", "id as component"))


def test_maps_are_coarsened_in_place_as_by_joins(spark):
    r, a, c = (cut(t.where("map_id < 12")) for t in visibility.region_tables(skylines(spark, SF)))
    a = cut(a.withColumns({e: F.when(F.col("arc_id") != 20, F.col(e)) for e in ("first_edge", "last_edge")}))
    few, wide = (regions.coarsen(r, a, c, 6, below=8, small=small) for small in (20_000, 0))
    for x, y in zip(few, (regions.region_weight(*wide[:2]), *wide[1:])):
        assert rows(x) == rows(y.select(*x.columns))
    assert few[2].count() < c.count()


def test_small_polygons_are_split_where_they_are(spark):
    v = cut(skylines(spark, SF))
    d = triangulation.diagonals(visibility.trapezoids(v), v)
    few, many = triangulation.pieces(v, d)
    assert many is None and "Join Inner, ((pid" not in (plan := few._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(pid#" in plan and ", idx#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    assert rows(triangulation.split_by_diagonals(v, d)) == rows(triangulation.split_by_diagonals(v, d, small=0))
    t = cut(triangulation.triangulate(v))
    assert rows(quality.check_area(t, v)) == rows(quality.check_area(t, v, small=0))


def test_region_tables_take_heights_without_joins(spark):
    v = cut(skylines(spark, SF))
    t = visibility.trapezoids(v, heights=True)
    assert "Join" not in t._jdf.queryExecution().optimizedPlan().toString()
    for x, y in zip(visibility.region_tables(v), visibility.region_tables(v, visibility.trapezoids(v))):
        assert rows(x.select(*y.columns)) == rows(y)
