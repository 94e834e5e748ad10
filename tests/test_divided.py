"""Separators of small graphs where they lie, against the rounds of joins of giant ones."""

from pyspark.sql import functions as F

from geoloom.operators import graphs, quality
from geoloom.plans.fixtures import grid, stacked
from geoloom.plans.iterate import cut

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    out = cut(work())
    spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_small_graphs_are_divided_in_place_as_by_joins(spark):
    v, e, half = map(cut, stacked(spark, SF))
    few, n = jobs(spark, "divided", lambda: graphs.find_separator(v, e, half=half))
    assert n < 10 and rows(few) == rows(graphs.find_separator(v, e, half=half, small=0))


def sound(out, v, e, most):
    """Pieces within bounds, and no edge from one to another."""
    part = out.where("not is_separator").select("gid", "v", "piece_id")
    ends = e.join(part.select("gid", F.col("v").alias("u"), F.col("piece_id").alias("p")), ["gid", "u"]).join(part.select("gid", "v", F.col("piece_id").alias("q")), ["gid", "v"])
    return all(r.size_ok and r.all_ok and r.ids_ok for r in quality.check_pieces(out, v, most).collect()) and ends.where("p <> q").isEmpty() and not ends.isEmpty()


def test_small_graphs_are_cut_into_pieces_without_rounds_of_jobs(spark):
    for (v, e, half), name in ((tuple(map(cut, stacked(spark, SF))), "stacked"), ((*map(cut, grid(spark, SF)), None), "grids")):
        out, n = jobs(spark, name, lambda: graphs.iterated_separator(v, e, 30, half=half))  # noqa: B023
        assert n < 10 and sound(out, v, e, 30)


def test_pieces_of_giant_graphs_go_in_place_once_they_are_small(spark):
    v, e = map(cut, grid(spark, SF))
    assert sound(cut(graphs.iterated_separator(v, e, 30, small=200)), v, e, 30)


def test_graphs_of_both_sizes_and_without_edges(spark):
    v, e = map(cut, grid(spark, SF))
    odd = v.where("gid = 0").select(F.lit(9).cast("long").alias("gid"), "v", F.lit(1.0).alias("cost")).where("v < 40")
    v, e = cut(v.unionByName(odd)), cut(e.where("gid < 2 and (u * 7 + v) % 5 > 0"))  # in parts, gid 9 without edges
    assert rows(graphs.find_separator(v, e, small=100)) == rows(graphs.find_separator(v, e)) == rows(graphs.find_separator(v, e, small=0))
