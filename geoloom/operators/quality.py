"""Checks of triangulations, partitions and polygons; each returns the offending rows or a row of flags per key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packed import areas
from ..functions.plane import orient2d
from ..plans.iterate import cut
from .chains import holding
from .rings import ring_neighbors, signed_area


def _sizes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("pid").agg(F.count("*").alias("n"))


def check_triangle_ids(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with an id out of range or twice."""
    t = triangles.join(_sizes(vertices), "pid")
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < F.col("n"))
    return t.where(~(inside("a") & inside("b") & inside("c") & (F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c")))).drop("n")


def triangle_edges(triangles: DataFrame) -> DataFrame:
    pair = lambda x, y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    return triangles.select("pid", F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("a", "c"))).alias("e")).select("pid", "e.u", "e.v")


def check_edge_use(triangles: DataFrame) -> DataFrame:
    """Edges in more than two triangles."""
    return triangle_edges(triangles).groupBy("pid", "u", "v").agg(F.count("*").alias("uses")).where("uses > 2")


def check_coverage(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices in no triangle."""
    used = triangles.select("pid", F.explode(F.array("a", "b", "c")).alias("idx"))
    return vertices.select("pid", "idx").join(used, ["pid", "idx"], "left_anti")


def check_count(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Polygons whose number of triangles isn't n - 2."""
    t = triangles.groupBy("pid").agg(F.count("*").alias("triangles"))
    return _sizes(vertices).join(t, "pid", "left").na.fill(0, ["triangles"]).where("triangles <> n - 2")


def check_area(triangles: DataFrame, vertices: DataFrame, small: int = 20_000) -> DataFrame:
    """area2 of each polygon and the sum of its triangles'. Polygons of up to `small` vertices are an array each; corners of larger ones are joined."""
    p = vertices.select("pid", "idx", "x", "y")
    big = cut(_sizes(p).where(F.col("n") > small).select("pid"))
    some = not big.isEmpty()
    own = p.join(big, "pid", "left_anti") if some else p
    rings = own.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("v_"))
    few = triangles.join(big, "pid", "left_anti") if some else triangles
    few = few.groupBy("pid").agg(F.collect_list(F.struct("a", "b", "c")).alias("t_")).join(rings, "pid")
    s = few.select("pid", F.arrow_udf(areas, "double")("v_", "t_").alias("triangles2")).where("triangles2 is not null")
    if some:
        t = triangles.join(big, "pid", "left_semi")
        for c in "abc":
            t = t.join(p.select("pid", F.col("idx").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), ["pid", c])
        s = s.unionByName(t.groupBy("pid").agg(F.sum(F.abs(orient2d("ax", "ay", "bx", "by", "cx", "cy"))).alias("triangles2")))
    return signed_area(vertices).join(s, "pid", "left")


def check_simple(vertices: DataFrame) -> DataFrame:
    """Pairs of edges that cross in their inner points. Edges meet only where their x ranges overlap, by numbered x: the range of one then holds the other's lower end."""
    v = vertices.select("pid", "idx", "x", "y", F.dense_rank().over(Window.partitionBy("pid").orderBy("x")).cast("long").alias("k"))
    e = ring_neighbors(v, ("x", "y", "k")).select("pid", F.col("idx").alias("e"), "x", "y", F.col("next_x").alias("u"), F.col("next_y").alias("w"), F.least("k", "next_k").alias("lo"), F.greatest("k", "next_k").alias("hi"))
    b = e.select("pid", *[F.col(c).alias(f"o_{c}") for c in ("e", "x", "y", "u", "w", "lo")])
    p = holding(b, e, ["pid"], F.col("o_lo"), F.col("lo"), F.col("hi")).where("lo < o_lo or e < o_e")
    side = lambda ax, ay, bx, by, cx, cy: F.signum(orient2d(ax, ay, bx, by, cx, cy))
    one = side("x", "y", "u", "w", "o_x", "o_y") * side("x", "y", "u", "w", "o_u", "o_w")
    two = side("o_x", "o_y", "o_u", "o_w", "x", "y") * side("o_x", "o_y", "o_u", "o_w", "u", "w")
    return p.where((one < 0) & (two < 0)).select("pid", F.least("e", "o_e").alias("e"), F.greatest("e", "o_e").alias("other"))


def check_partition(parts: DataFrame, g_vertices: DataFrame) -> DataFrame:
    """Vertices in none or several of A, B, C."""
    n = parts.groupBy("gid", "v").agg(F.count("*").alias("times"))
    return g_vertices.select("gid", "v").join(n, ["gid", "v"], "full_outer").na.fill(0, ["times"]).where("times <> 1")


def check_balance(parts: DataFrame, g_vertices: DataFrame) -> DataFrame:
    """A row for each graph: whether A and B weigh at most two thirds, and C has at most 2 sqrt(2 n) vertices."""
    p = parts.join(g_vertices, ["gid", "v"])
    w = lambda k: F.coalesce(F.sum(F.when(F.col("part") == k, F.col("cost"))), F.lit(0.0))
    s = p.groupBy("gid").agg(w("A").alias("a"), w("B").alias("b"), F.sum("cost").alias("all"), F.count("*").alias("n"), F.count(F.when(F.col("part") == "C", 1)).alias("c"))
    return s.select("gid", (F.col("a") * 3 <= F.col("all") * 2 + 1e-9).alias("a_ok"), (F.col("b") * 3 <= F.col("all") * 2 + 1e-9).alias("b_ok"), (F.col("c") <= 2 * math.sqrt(2) * F.sqrt("n")).alias("c_ok"))


def check_cross_edges(parts: DataFrame, g_edges: DataFrame) -> DataFrame:
    """Edges between A and B."""
    a, b = parts.select("gid", F.col("v").alias("u"), F.col("part").alias("pu")), parts.select("gid", "v", F.col("part").alias("pv"))
    return g_edges.join(a, ["gid", "u"]).join(b, ["gid", "v"]).where("pu <> pv and pu <> 'C' and pv <> 'C'").select("gid", "u", "v")


def check_pieces(pieces: DataFrame, g_vertices: DataFrame, most: int) -> DataFrame:
    """A row for each graph: largest piece within bounds, all vertices placed, separators without and others with a piece."""
    size = pieces.where("piece_id is not null").groupBy("gid", "piece_id").agg(F.count("*").alias("n")).groupBy("gid").agg((F.max("n") <= most).alias("size_ok"))
    flags = pieces.groupBy("gid").agg(F.count("*").alias("placed"), F.count_distinct("v").alias("different"), F.bool_and(F.col("is_separator") == F.col("piece_id").isNull()).alias("ids_ok"))
    all_ = g_vertices.groupBy("gid").agg(F.count("*").alias("n"))
    return all_.join(flags, "gid").join(size, "gid", "left").select("gid", "size_ok", ((F.col("placed") == F.col("n")) & (F.col("different") == F.col("n"))).alias("all_ok"), "ids_ok")
