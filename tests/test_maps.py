"""Region maps: chords taken out, and operators on one array a map against those by joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import geoloom.queries_regions as q
from geoloom.functions.maps import held
from geoloom.operators import graphs, maps, regions, visibility
from geoloom.plans.fixtures import skylines
from geoloom.plans.iterate import cut
from geoloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMED = ("m18_decomposition_tree", "m6_coarsen_first", "m12_chord_adjacent_arcs_visible", "m5_contract_chords_visible", "m16_internal_chords_visible", "m14_region_adjacency_visible", "m9_locate_on_arcs_at_height")


def rows(df):
    return sorted(map(str, df.collect()))


def test_an_arc_without_edges_joins_the_sums_of_both_ends(spark):
    r = spark.createDataFrame([(1, 0), (1, 1)], "map_id long, region_id long")
    arc = "map_id long, arc_id long, region_id long, first_edge long, last_edge long, first_side string, last_side string, edge_count long"
    a = spark.createDataFrame([(1, 0, 0, 0, 3, "L", "L", 22), (1, 1, 0, 4, 6, "L", "L", 0), (1, 2, 1, 6, 8, "L", "L", 6)], arc)
    c = spark.createDataFrame([(1, 0, 0, 1, 4, 6, 1.0, False)], "map_id long, chord_id long, region_a long, region_b long, left_edge long, right_edge long, y double, is_null_length boolean")
    assert regions.merged_weights(r, a, c).first().merged == 28
    for small in (20_000, 0):
        kept, arcs, chords = regions.coarsen(r, a, c, 25, small=small)
        assert chords.count() == 1 and arcs.agg(F.max("edge_count")).first()[0] == 22
        assert regions.coarsen(r, a, c, 28, small=small)[1].agg(F.max("edge_count")).first()[0] == 28


@pytest.fixture(scope="module")
def some(spark):
    """Skylines of parts, and one of all line items of a few suppliers."""
    return cut(skylines(spark, SF).where("pid < 25").unionByName(skylines(spark, SF, "l_suppkey").where("pid < 2").withColumn("pid", F.col("pid") + 10_000)))


@pytest.fixture(scope="module")
def both(some):
    placed, giant = maps.region_maps(some)
    assert giant is None
    return placed, [cut(t) for t in visibility.region_tables(some)]


def test_maps_in_place_are_the_region_tables(both):
    placed, (r, a, c) = both
    assert rows(placed.select("map_id", F.explode("r_").alias("region_id"))) == rows(r)
    assert rows(placed.select("map_id", F.inline("a_"))) == rows(a)
    assert rows(placed.select("map_id", F.inline("c_"))) == rows(c)


def test_what_lies_on_maps_in_place_is_what_joins_find(both):
    placed, (r, a, c) = both
    assert rows(maps.chord_adjacent_arcs(placed)) == rows(regions.chord_adjacent_arcs(c, a))
    assert rows(maps.region_adjacency(placed)) == rows(regions.region_adjacency(c, a))
    assert rows(maps.internal_chords(placed)) == rows(regions.internal_chords(a, c))
    asked = F.transform("c_", lambda x: F.struct(x["chord_id"].alias("query_id"), x["left_edge"].alias("e"), x["y"].alias("y")))
    assert rows(maps.locate_on_arcs(placed, asked)) == rows(regions.locate_on_arcs(c.select("map_id", F.col("chord_id").alias("query_id"), F.col("left_edge").alias("e"), "y"), a))


def test_chords_leave_maps_in_place_as_by_joins(both):
    placed, (r, a, c) = both
    got = cut(maps.contract_chords(placed, lambda x: x["chord_id"] % 4 == 0))
    weights, glued, kept = regions.contract_chords(r, a, c, c.where("chord_id % 4 = 0").select("map_id", "chord_id"))
    assert rows(got.select("map_id", F.inline("a_"))) == rows(glued.join(weights, ["map_id", "region_id"]).select("map_id", *regions.GLUED[3:4], "region_id", "first_edge", "last_edge", "first_side", "last_side", "edge_count", "weight"))
    assert rows(got.select("map_id", F.inline("c_"))) == rows(kept)
    assert rows(placed.select("map_id", F.inline(maps.merged_weights(placed)))) == rows(regions.merged_weights(r, a, c))


def test_trees_of_maps_are_split_in_place_as_by_rounds(both):
    placed, (r, _, c) = both
    e = c.where("not is_null_length").select(F.col("map_id").alias("gid"), F.col("region_a").alias("u"), F.col("region_b").alias("v"))
    tree = cut(graphs.bfs(r.select(F.col("map_id").alias("gid"), F.col("region_id").alias("v")), e).select("gid", "v", "parent"))
    got = cut(maps.decomposition_tree(placed))
    splits = cut(regions.center_tree(tree))
    names = ["gid", "v", "parent", "part", "depth", "size", "larger"]
    assert rows(got.select("gid", F.inline("s_")).select(names)) == rows(splits.select(names))
    names = ["gid", "node", "v", "cut_parent", "region", "parent", "depth"]
    assert rows(got.select("gid", F.inline("t_")).select(names)) == rows(regions.decomposition_tree(tree, splits).select(names))
    broken = got.withColumn("t_", F.filter("t_", lambda x: x["node"] != F.get("t_", F.lit(1))["node"]))
    assert maps.tree_flags(got).where("good and roots = 1 and levels_ok and balanced").count() == got.count() and not maps.tree_flags(broken).where("good and roots = 1 and levels_ok").count()


def test_ranges_hold_points_once():
    rng = np.random.default_rng(7)
    key, at, of, lo = (rng.integers(-3, 40, 300) for _ in range(4))
    hi = lo + rng.integers(-1, 90, 300) ** 2 // 40
    i, j = held(key, at, of, lo, hi)
    want = np.argwhere((key[:, None] == of) & (lo <= at[:, None]) & (at[:, None] <= hi))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("name", NAMED)
def test_maps_in_place_are_shuffled_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_giant_polygons_take_tables(spark, some, monkeypatch):
    v, whole = some.where("pid > 20"), maps.region_maps
    monkeypatch.setattr(q, "skylines", lambda *_: v)
    monkeypatch.setattr(q.maps, "region_maps", lambda v: whole(v, small=40))
    few, many = whole(v, 40)
    assert few.count() and many[0].count()
    mixed = [rows(QUERIES[name](spark, SF)) for name in NAMED]
    monkeypatch.setattr(q.maps, "region_maps", whole)
    assert mixed == [rows(QUERIES[name](spark, SF)) for name in NAMED]
