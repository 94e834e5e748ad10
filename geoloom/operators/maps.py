"""Visibility maps in place: a row for each polygon of up to `small` vertices, with its regions, arcs and chords as arrays (map_id, r_, a_, c_).

What operators.regions does by joins is done here on the arrays, where they are: nothing is shuffled or written once the vertices lie by polygon. Maps of giant
polygons take tables and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maps as on
from ..functions.packed import COARSE, MERGED, WEIGHED, coarser, contracted, merged
from ..plans.iterate import cut
from .visibility import region_tables

ROW = tuple[DataFrame, DataFrame, DataFrame]


def region_maps(vertices: DataFrame, small: int = 2000) -> tuple[DataFrame, ROW | None]:
    """(maps of polygons of up to `small` vertices, visibility.region_tables of larger ones or None) for counter-clockwise polygons; vertices are read twice."""
    v = vertices.select("pid", "idx", "x", "y")
    large = cut(v.groupBy("pid").agg(F.count("*").alias("n_")).where(F.col("n_") > small).select("pid"))
    some = not large.isEmpty()
    rings = (v.join(large, "pid", "left_anti") if some else v).groupBy(F.col("pid").alias("map_id")).agg(F.collect_list(F.struct("idx", "x", "y")).alias("v_"))
    rows = rings.select("map_id", F.arrow_udf(on.visible, on.VISIBLE)("v_").alias("m_")).select("map_id", F.col("m_.regions").alias("r_"), F.col("m_.arcs").alias("a_"), F.col("m_.chords").alias("c_"))
    return rows, region_tables(v.join(large, "pid", "left_semi")) if some else None


def locate_on_arcs(maps: DataFrame, query: Column) -> DataFrame:
    """regions.locate_on_arcs, for queries (query_id, e, y) as an array."""
    return maps.select("map_id", F.inline(F.arrow_udf(on.located, on.LOCATED)(query, F.col("a_"))))


def chord_adjacent_arcs(maps: DataFrame) -> DataFrame:
    return maps.select("map_id", F.inline(F.arrow_udf(on.adjacent, on.ADJACENT)("a_", "c_")))


def region_adjacency(maps: DataFrame) -> DataFrame:
    return maps.select("map_id", F.inline(F.arrow_udf(on.paired, on.PAIRED)("a_", "c_")))


def internal_chords(maps: DataFrame) -> DataFrame:
    return maps.select("map_id", F.inline(F.arrow_udf(on.internal, on.INTERNAL)("a_", "c_")))


def _asked() -> tuple[Column, Column]:
    """Arcs and chords as functions.packed.Maps takes them; no end of a chord is a vertex, so all vanish."""
    arcs = F.transform("a_", lambda x: F.struct(*[x[c].alias(c) for c in ("arc_id", "region_id", "first_edge", "last_edge", "first_side", "last_side", "edge_count")]))
    no = F.lit(False)
    chords = F.transform("c_", lambda x: F.struct(x["chord_id"].alias("chord_id"), x["region_a"].alias("region_a"), x["region_b"].alias("region_b"), F.least(x["left_edge"], x["right_edge"]).alias("lo"), F.greatest(x["left_edge"], x["right_edge"]).alias("hi"), no.alias("lo_fixed"), no.alias("hi_fixed")))
    return arcs, chords


CHORD = ("chord_id", "region_a", "region_b", "left_edge", "right_edge", "y", "is_null_length")


def _after(maps: DataFrame, step: Column) -> DataFrame:
    kept = F.transform("z_.chords", lambda x: F.struct(*[x[y].alias(y) if y in ("region_a", "region_b") else F.get("c_", x["at"])[y].alias(y) for y in CHORD]))
    after = F.struct(F.col("z_.regions").alias("r_"), F.col("z_.arcs").alias("a_"), kept.alias("c_"))
    return maps.withColumn("z_", step).select("map_id", F.inline(F.array(after)))  # as one row, so that a later step doesn't take this one again


def contract_chords(maps: DataFrame, drop) -> DataFrame:
    """Maps without the chords for which drop, a function of a chord, holds; arcs have the weight of their region. See regions.contract_chords."""
    return _after(maps, F.arrow_udf(contracted, WEIGHED)("map_id", "r_", *_asked(), F.transform("c_", drop)))


def coarsen(maps: DataFrame, gamma: int, below: int | None = None, most: int = 200) -> DataFrame:
    return _after(maps, F.arrow_udf(coarser(gamma, below, most), COARSE)("map_id", "r_", *_asked()))


def merged_weights(maps: DataFrame) -> Column:
    """An array of (chord_id, region_a, region_b, da, db, merged): see regions.merged_weights."""
    return F.arrow_udf(merged, MERGED)("map_id", "r_", *_asked())


def decomposition_tree(maps: DataFrame) -> DataFrame:
    """(gid, s_, t_): splits and nodes (see regions.center_tree and decomposition_tree) of the region tree of each map, rooted at its lowest region by a walk over chords."""
    chords = F.filter("c_", lambda x: ~x["is_null_length"])
    step = lambda a, b: F.transform(chords, lambda x: F.struct(x[a].alias("v"), x[b].alias("to")))
    root = F.array(F.struct(F.array_min("r_").alias("v"), F.lit(None).cast("long").alias("to")))
    tree = F.arrow_udf(on.grown, on.TREE)(F.concat(step("region_a", "region_b"), step("region_b", "region_a"), root))
    return maps.select(F.col("map_id").alias("gid"), tree.alias("d_")).select("gid", F.col("d_.splits").alias("s_"), F.col("d_.nodes").alias("t_"))


def tree_flags(trees: DataFrame) -> DataFrame:
    """(gid, leaves, splits, good, roots, levels_ok, balanced) of what decomposition_tree gives; balanced: no part ever held more than three quarters (and a quarter vertex) of what was split."""
    asked = F.transform("t_", lambda x: F.struct(*[x[c].alias(c) for c in ("node", "region", "parent", "depth")]))
    return trees.select("gid", F.forall("s_", lambda x: x["larger"] * 4 <= x["size"] * 3 + 1).alias("balanced"), F.arrow_udf(on.flagged, on.FLAGS)(asked).alias("f_")).select("gid", "f_.*", "balanced")
