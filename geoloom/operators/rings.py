"""Vertices and rings: projections, filters and windows over vertices(pid, idx, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plane import convexity, edge_x, orient2d, y_compare, y_order
from ..plans.ordered import neighbours, ranks


def validate_polygons(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices of polygons with at least 3, vertices of the others)."""
    n = F.count("*").over(Window.partitionBy("pid"))
    marked = vertices.withColumn("n_", n)
    return marked.where("n_ >= 3").drop("n_"), marked.where("n_ < 3").drop("n_")


def index_vertices(points: DataFrame, pos: str) -> DataFrame:
    """idx 0, 1, ... along pos."""
    return points.withColumn("idx", (F.row_number().over(Window.partitionBy("pid").orderBy(pos)) - 1).cast("long"))


def y_rank(vertices: DataFrame, ranged: bool = False) -> DataFrame:
    """rk: place from low to high in the polygon, ties by x, then idx. ranged: for giant rings, in ranges over all tasks (plans.ordered) in place of one window a ring."""
    order = [F.col(c) for c in ("y", "x", "idx")]
    if ranged:
        return ranks(vertices, ["pid"], order, "rk")
    return vertices.withColumn("rk", F.row_number().over(Window.partitionBy("pid").orderBy(*order)))


def ring_neighbors(vertices: DataFrame, carry: tuple[str, ...] = ("idx", "x", "y"), ranged: bool = False) -> DataFrame:
    """prev_* and next_* of the carried columns, around the ring; n: the ring's size. One sort by idx serves all. ranged: see y_rank."""
    if ranged:
        near = [f"{side}{c}" for side in ("prev_", "next_") for c in carry]
        out = neighbours(vertices, ["pid"], [F.col("idx")], list(carry)).join(vertices.groupBy("pid").agg(F.count("*").alias("n")), "pid")
        return out.select(*vertices.columns, "n", *near)
    w = Window.partitionBy("pid").orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct(*carry)
    out = vertices.select("*", F.coalesce(F.lag(here).over(w), F.last(here).over(whole)).alias("p_"), F.coalesce(F.lead(here).over(w), F.first(here).over(whole)).alias("q_"), F.count("*").over(whole).alias("n"))
    return out.select("*", *[F.col(f"p_.{c}").alias(f"prev_{c}") for c in carry], *[F.col(f"q_.{c}").alias(f"next_{c}") for c in carry]).drop("p_", "q_")


def ring(vertices: DataFrame, ranged: bool = False) -> DataFrame:
    """Ranked vertices with their neighbours."""
    return ring_neighbors(y_rank(vertices, ranged), ("idx", "x", "y", "rk"), ranged)


def ring_edges(vertices: DataFrame, closed: bool = True) -> DataFrame:
    """Edge e joins vertex e (a) and the next (b); an open curve has no closing edge."""
    out = ring_neighbors(vertices, ("idx",))
    if not closed:
        out = out.where("next_idx > idx")
    return out.select("pid", F.col("idx").alias("e"), F.col("idx").alias("a"), F.col("next_idx").alias("b"))


def _power(n) -> F.Column:
    """p with 2**p + 1 the least such number not below n, found on integers."""
    p = F.lit(0)
    for k in range(40):
        p = p + F.when(F.lit(2**k + 1) < n, 1).otherwise(0)
    return p


def pad_ring(vertices: DataFrame) -> DataFrame:
    """Puts evenly spaced points on the edge from the last but one vertex to the last until there are 2**p + 1; the last vertex gets the last idx."""
    n = F.count("*").over(Window.partitionBy("pid"))
    rows = vertices.withColumn("n", n).withColumn("size", F.pow(F.lit(2.0), _power(F.col("n"))).cast("long") + 1).withColumn("k", F.col("size") - F.col("n"))
    w = Window.partitionBy("pid").orderBy("idx")
    rows = rows.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w))
    moved = rows.withColumn("idx", F.when(F.col("idx") == F.col("n") - 1, F.col("size") - 1).otherwise(F.col("idx"))).select("pid", "idx", "x", "y")
    share = F.col("j") / (F.col("k") + 1)
    extra = rows.where((F.col("idx") == F.col("n") - 2) & (F.col("k") > 0)).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    extra = extra.select("pid", (F.col("idx") + F.col("j")).alias("idx"), (F.col("x") + share * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("ny") - F.col("y"))).alias("y"))
    return moved.unionByName(extra)


def unpad_index(padded: DataFrame, n: str = "n", size: str = "size") -> DataFrame:
    """original: the vertex a padded index stands for; the first half of the padding goes to n - 2, the rest to n - 1."""
    i, k = F.col("idx"), F.col(size) - F.col(n)
    return padded.withColumn("original", F.when(i <= F.col(n) - 2, i).when(i - (F.col(n) - 2) <= F.floor(k / 2), F.col(n) - 2).otherwise(F.col(n) - 1))


def compare_points(pairs: DataFrame) -> DataFrame:
    """cmp and less for pairs with columns a_y, a_x, a_idx, b_y, b_x, b_idx."""
    a, b = y_order("a_y", "a_x", "a_idx"), y_order("b_y", "b_x", "b_idx")
    return pairs.withColumn("cmp", y_compare(a, b)).withColumn("less", a < b)


def y_extrema(vertices: DataFrame, closed: bool = False) -> DataFrame:
    """kind: min, max or neither; the ends of an open curve are neither."""
    r = ring(vertices)
    low = (F.col("rk") < F.col("prev_rk")) & (F.col("rk") < F.col("next_rk"))
    high = (F.col("rk") > F.col("prev_rk")) & (F.col("rk") > F.col("next_rk"))
    end = F.lit(False) if closed else is_endpoint()
    return r.withColumn("kind", F.when(end, "neither").when(low, "min").when(high, "max").otherwise("neither"))


def is_endpoint() -> F.Column:
    return (F.col("idx") == 0) | (F.col("idx") == F.col("n") - 1)


def vertex_convexity(vertices: DataFrame) -> DataFrame:
    """turn and kind of each vertex."""
    r = ring_neighbors(vertices)
    turn = orient2d("prev_x", "prev_y", "x", "y", "next_x", "next_y")
    return r.withColumn("turn", turn).withColumn("kind", convexity(turn))


def edge_x_at_y(queries: DataFrame, vertices: DataFrame) -> DataFrame:
    """hit_x for queries (pid, e, y); null for an edge that isn't there."""
    e = ring_neighbors(vertices).select("pid", F.col("idx").alias("e"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("next_x").alias("bx"), F.col("next_y").alias("by"))
    return queries.join(e, ["pid", "e"], "left").withColumn("hit_x", edge_x("ax", "ay", "bx", "by", "y")).drop("ax", "ay", "bx", "by")


def signed_area(vertices: DataFrame) -> DataFrame:
    """area2: twice the signed area of each polygon; positive if counter-clockwise."""
    return ring_neighbors(vertices).groupBy("pid").agg(F.sum(F.col("x") * F.col("next_y") - F.col("next_x") * F.col("y")).alias("area2"))


def orient_ccw(vertices: DataFrame) -> DataFrame:
    """The vertices with idx turned round in clockwise polygons (vertex 0 stays)."""
    r = ring_neighbors(vertices)
    area = F.sum(F.col("x") * F.col("next_y") - F.col("next_x") * F.col("y")).over(Window.partitionBy("pid"))
    return r.withColumn("a_", area).withColumn("idx", F.when(F.col("a_") < 0, F.pmod(F.col("n") - F.col("idx"), F.col("n"))).otherwise(F.col("idx"))).select(*vertices.columns)
