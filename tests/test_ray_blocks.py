"""Rays of giant polygons in blocks of ranks, and rings of bounded size by windows where giant ones are sorted in ranges."""

import pytest
from pyspark.sql import functions as F

from geoloom.operators import rings, visibility
from geoloom.plans import ordered
from geoloom.plans.fixtures import skylines
from geoloom.plans.iterate import cut

SF = "/root/testdata/sf0.001"
HITS = ["pid", "idx", "hl", "hl_x", "hr", "hr_x"]


def rows(df):
    return sorted(map(str, df.collect()))


def by_pairs(v, closed=True):
    """Hits from all pairs of a vertex and an edge of its polygon."""
    r = rings.ring(v)
    hits = visibility.nearest(visibility._pairs(r.select("pid", "idx", "x", "y", "rk", "n"), visibility.edges_of(r, closed), 10**9), ["pid", "idx"], F.col("x"), F.col("y"))
    return r.select("pid", "idx").join(hits, ["pid", "idx"], "left").select(HITS)


def polygons(spark):
    """Skylines, steep combs whose edges lie over many blocks, and zigzags with slanted sides."""
    teeth = spark.range(400).select(F.lit(-1).cast("long").alias("pid"), (F.col("id") + 2).alias("idx"), (400 - F.col("id")).cast("double").alias("x"), F.expr("if(id % 2 = 0, 1000.0D + id * 37 % 101, id * 53 % 97 + 0D)").alias("y"))
    foot = spark.createDataFrame([(-1, 0, 0.0, -5.0), (-1, 1, 401.0, -5.0)], "pid long, idx long, x double, y double")
    comb = teeth.unionByName(foot)
    slanted = comb.select(F.lit(-2).cast("long").alias("pid"), "idx", (F.col("x") * 3 + F.col("y") / 7).alias("x"), "y")
    return cut(skylines(spark, SF, "l_suppkey").unionByName(comb).unionByName(slanted))


@pytest.mark.parametrize("grade", [2, 6])
def test_rays_in_blocks_meet_what_pairs_meet(spark, monkeypatch, grade):
    v = polygons(spark)
    monkeypatch.setattr(visibility, "GRADE", grade)
    for closed in (True, False):
        want = rows(by_pairs(v, closed))
        for small in (0, 500):
            assert rows(visibility.ray_shoot(v, closed, small=small).select(HITS)) == want


def test_rings_of_both_sizes_have_the_same_trapezoids(spark, monkeypatch):
    v = cut(skylines(spark, SF))
    want = rows(visibility.trapezoids(v))
    monkeypatch.setattr(visibility, "GRADE", 4)
    for wide in (15, 31):  # rings above these are giant
        monkeypatch.setattr(visibility, "WIDE", wide)
        assert rows(visibility.trapezoids(v, small=0, ranged=True)) == want


def test_rings_of_bounded_size_take_no_sorts_in_ranges(spark, monkeypatch):
    v = cut(skylines(spark, SF))

    def sliced(*_):
        raise AssertionError("small rings are sorted in ranges")

    monkeypatch.setattr(ordered, "sliced", sliced)
    got = visibility.trapezoids(v, small=0, ranged=True)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and rows(got) == rows(visibility.trapezoids(v))
