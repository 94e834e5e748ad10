"""Polygons and graphs derived from the star-schema tables, as frames and as SQL text for checks.

Skyline polygon of a key: the quantities of its line items, in a fixed order, are the roof over a base
at y = -1. It is simple, counter-clockwise, has exact coordinates and many ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .iterate import cut

ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


def skylines(spark: SparkSession, sf_dir: str, key: str = "l_partkey") -> DataFrame:
    """vertices(pid, idx, x, y)."""
    roof = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col(key).alias("pid"), F.col("l_quantity").cast("double").alias("q"), *ORDER)
    w = Window.partitionBy("pid")
    roof = roof.select("pid", "q", (F.row_number().over(w.orderBy(*ORDER)) - 1).cast("long").alias("k"), F.count("*").over(w).alias("m")).where("m >= 2")
    point = lambda i, x, y: F.struct(i.alias("idx"), x.cast("double").alias("x"), y.alias("y"))
    top = point(F.col("m") + 1 - F.col("k"), F.col("k"), F.col("q"))
    base = F.array(point(F.lit(0).cast("long"), F.lit(0), F.lit(-1.0)), point(F.lit(1).cast("long"), F.col("m") - 1, F.lit(-1.0)), top)
    return roof.select(F.col("pid").cast("long").alias("pid"), F.explode(F.when(F.col("k") == 0, base).otherwise(F.array(top))).alias("v")).select("pid", "v.*")


def skyline_sql(key: str = "l_partkey") -> str:
    """Common table expressions v (vertices) and ring (vertices with ranks and neighbours)."""
    return f"""
roof AS (SELECT {key} AS pid, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(ORDER)}) - 1 AS k, count(*) OVER (PARTITION BY {key}) AS m FROM lineitem),
v AS (SELECT pid, m + 1 - k AS idx, CAST(k AS DOUBLE) AS x, q AS y FROM roof WHERE m >= 2
  UNION ALL SELECT pid, 0, 0.0, -1.0 FROM roof WHERE m >= 2 AND k = 0
  UNION ALL SELECT pid, 1, CAST(m - 1 AS DOUBLE), -1.0 FROM roof WHERE m >= 2 AND k = 0),
r AS (SELECT *, count(*) OVER (PARTITION BY pid) AS n, row_number() OVER (PARTITION BY pid ORDER BY y, x, idx) AS rk FROM v),
ring AS (SELECT pid, idx, x, y, n, rk, coalesce(lag(idx) OVER w, n - 1) AS prev_idx, coalesce(lag(x) OVER w, last_value(x) OVER f) AS prev_x, coalesce(lag(y) OVER w, last_value(y) OVER f) AS prev_y, coalesce(lag(rk) OVER w, last_value(rk) OVER f) AS prev_rk,
  coalesce(lead(idx) OVER w, 0) AS next_idx, coalesce(lead(x) OVER w, first_value(x) OVER f) AS next_x, coalesce(lead(y) OVER w, first_value(y) OVER f) AS next_y, coalesce(lead(rk) OVER w, first_value(rk) OVER f) AS next_rk
  FROM r WINDOW w AS (PARTITION BY pid ORDER BY idx), f AS (PARTITION BY pid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


WIDTH = 20
BLOCK = 100


def grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(g_vertices, g_edges): a grid of the parts, WIDTH wide, the part size as cost."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("v"), F.col("p_size").cast("double").alias("cost"))
    v = parts.select(F.expr(f"v div {BLOCK}").alias("gid"), "v", "cost")
    there = v.select("gid", F.col("v").alias("w"))
    right = v.where(F.col("v") % WIDTH < WIDTH - 1).select("gid", F.col("v").alias("u"), (F.col("v") + 1).alias("w"))
    down = v.select("gid", F.col("v").alias("u"), (F.col("v") + WIDTH).alias("w"))
    e = right.unionByName(down).join(there, ["gid", "w"], "left_semi").select("gid", "u", F.col("w").alias("v"))
    return v, e


GRID_SQL = f"""
gv AS (SELECT CAST(p_partkey // {BLOCK} AS BIGINT) AS gid, CAST(p_partkey AS BIGINT) AS v, CAST(p_size AS DOUBLE) AS cost FROM part),
ge AS (SELECT a.gid, a.v AS u, b.v AS v FROM gv a JOIN gv b ON a.gid = b.gid AND ((b.v = a.v + 1 AND a.v % {WIDTH} < {WIDTH - 1}) OR b.v = a.v + {WIDTH}))"""


def region_map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, arcs, chords): one map for each part, an arc for each of its line items, three arcs to a region and a chord from each region to the next."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").cast("long").alias("map_id"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("q"), *ORDER)
    a = rows.select("map_id", "n", "q", (F.row_number().over(Window.partitionBy("map_id").orderBy(*ORDER)) - 1).cast("long").alias("arc_id"))
    arcs = a.select("map_id", "arc_id", F.expr("arc_id div 3").alias("region_id"), (F.col("arc_id") * 2).alias("first_edge"), (F.col("arc_id") * 2 + F.col("q") % 3).alias("last_edge"), F.when(F.col("n") % 2 == 1, "L").otherwise("R").alias("first_side"), F.when(F.col("n") % 2 == 1, "L").otherwise("R").alias("last_side"), (F.col("q") % 11).alias("edge_count"))
    regions = arcs.select("map_id", "region_id").distinct()
    last = regions.groupBy("map_id").agg(F.max("region_id").alias("last"))
    c = a.where("arc_id % 3 = 2").join(last, "map_id").withColumn("r", F.expr("arc_id div 3")).where("r < last")
    chords = c.select("map_id", F.col("r").alias("chord_id"), F.col("r").alias("region_a"), (F.col("r") + 1).alias("region_b"), (F.col("r") * 6 + F.col("q") % 5).alias("left_edge"), (F.col("r") * 6 + F.col("q") % 17).alias("right_edge"), F.col("q").cast("double").alias("y"), (F.col("q") % 5 == F.col("q") % 17).alias("is_null_length"))
    return regions, arcs, chords


REGION_SQL = f"""
a AS (SELECT CAST(l_partkey AS BIGINT) AS map_id, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(ORDER)}) - 1 AS arc_id FROM lineitem),
arcs AS (SELECT map_id, arc_id, arc_id // 3 AS region_id, arc_id * 2 AS first_edge, arc_id * 2 + q % 3 AS last_edge, CASE WHEN n % 2 = 1 THEN 'L' ELSE 'R' END AS first_side, q % 11 AS edge_count FROM a),
regions AS (SELECT DISTINCT map_id, region_id FROM arcs),
chords AS (SELECT map_id, arc_id // 3 AS chord_id, arc_id // 3 AS region_a, arc_id // 3 + 1 AS region_b, (arc_id // 3) * 6 + q % 5 AS left_edge, (arc_id // 3) * 6 + q % 17 AS right_edge, CAST(q AS DOUBLE) AS y, q % 5 = q % 17 AS is_null_length FROM a JOIN (SELECT map_id AS m, max(region_id) AS last FROM regions GROUP BY 1) ON m = map_id WHERE arc_id % 3 = 2 AND arc_id // 3 < last),
ch AS (SELECT *, least(left_edge, right_edge) AS lo, greatest(left_edge, right_edge) AS hi FROM chords)"""


STACK = 400


def stacked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(g_vertices, g_edges, half): a stacked triangulation of every STACK parts, with its embedding; the part size as cost.

    Part i of a graph, from the fourth on, lies in the middle of triangle i - 3 and makes three of it; triangle g becomes 3 g + 1 to 3 g + 3."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr(f"p_partkey div {STACK}").alias("gid"), F.col("p_partkey").cast("long").alias("v"), F.col("p_size").cast("double").alias("cost"))
    i = F.row_number().over(Window.partitionBy("gid").orderBy("v")) - 1
    part = part.withColumn("i", i.cast("long"))
    up = [F.col("i") - 3]
    for _ in range(7):
        up.append(F.floor((up[-1] - 1) / 3))
    digits = F.transform(F.reverse(F.filter(F.array(*up), lambda t: t > 0)), lambda t: (t - 1) % 3)
    corner = lambda i, x, y: F.struct(F.lit(i).cast("long").alias("i"), F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    middle = lambda s: F.struct((s["g"] + 3).alias("i"), ((s["a"]["x"] + s["b"]["x"] + s["c"]["x"]) / 3).alias("x"), ((s["a"]["y"] + s["b"]["y"] + s["c"]["y"]) / 3).alias("y"))
    pick = lambda s, d, one, two, three: F.when(d == 0, s[one]).when(d == 1, s[two]).otherwise(s[three])
    begin = F.struct(corner(0, 0, 0).alias("a"), corner(1, 3**8, 0).alias("b"), corner(2, 0, 3**8).alias("c"), F.lit(0).cast("long").alias("g"))
    fold = lambda s, d: F.struct(pick(s, d, "a", "b", "c").alias("a"), pick(s, d, "b", "c", "a").alias("b"), middle(s).alias("c"), (s["g"] * 3 + 1 + d).alias("g"))
    inner = cut(part.where("i >= 3").select("gid", F.aggregate(digits, begin, fold).alias("t")))  # read for both ways and both tables
    me = F.col("i")
    inner = inner.withColumn("m", middle(F.col("t")))
    ends = inner.select("gid", F.col("m").alias("p"), F.explode(F.array("t.a", "t.b", "t.c")).alias("q"))
    outer = part.where("i = 1 or i = 2").select("gid", F.when(me == 1, F.array(F.struct(corner(0, 0, 0).alias("p"), corner(1, 3**8, 0).alias("q")))).otherwise(F.array(F.struct(corner(0, 0, 0).alias("p"), corner(2, 0, 3**8).alias("q")), F.struct(corner(1, 3**8, 0).alias("p"), corner(2, 0, 3**8).alias("q")))).alias("e"))
    ends = ends.unionByName(outer.select("gid", F.inline("e")))
    named = lambda c: part.select("gid", F.col("i").alias(f"{c}_i"), F.col("v").alias(c))
    both = ends.unionByName(ends.select("gid", F.col("q").alias("p"), F.col("p").alias("q")))
    half = both.select("gid", F.col("p.i").alias("tail_i"), F.col("q.i").alias("head_i"), (-F.atan2(F.col("q.y") - F.col("p.y"), F.col("q.x") - F.col("p.x"))).alias("pos"))
    half = half.join(named("tail"), ["gid", "tail_i"]).join(named("head"), ["gid", "head_i"]).select("gid", "tail", "head", "pos")
    return part.select("gid", "v", "cost"), half.where("tail < head").select("gid", F.col("tail").alias("u"), F.col("head").alias("v")), half


def nested_map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(regions, arcs, chords, new): one map for each supplier with an arc for each of its line items, all in region 0, old chords from there to
    regions without arcs, and new chords nested in each other, half as many deep as the map has arcs over 2, with smaller ones between them."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("long").alias("map_id"), F.col("l_quantity").cast("long").alias("q"), *ORDER)
    w = Window.partitionBy("map_id")
    a = cut(rows.select("map_id", "q", (F.row_number().over(w.orderBy(*ORDER)) - 1).cast("long").alias("j"), F.count("*").over(w).alias("m")))  # sorted once for all tables
    j, m = F.col("j"), F.col("m")
    zero, side = F.lit(0).cast("long"), F.lit("L")
    arcs = a.select("map_id", j.alias("arc_id"), zero.alias("region_id"), j.alias("first_edge"), j.alias("last_edge"), side.alias("first_side"), side.alias("last_side"), (F.col("q") % 11).alias("edge_count"))
    chord = lambda i, to, lo, hi: F.struct(i.alias("chord_id"), zero.alias("region_a"), to.alias("region_b"), lo.alias("left_edge"), hi.alias("right_edge"), F.col("q").cast("double").alias("y"), F.lit(False).alias("is_null_length"))
    old = a.where("j % 6 = 1").select("map_id", F.inline(F.array(chord(j, j + 1, j, j))))
    regions = a.where("j % 6 = 1").select("map_id", (j + 1).alias("region_id")).unionByName(a.select("map_id", zero.alias("region_id")).distinct())
    big = a.where("j % 2 = 0 and 2 * j < m - 1").select("map_id", F.inline(F.array(chord(10000 + j, zero, j, m - 1 - j))))
    little = a.where("j % 4 = 0 and 2 * (j + 3) < m").select("map_id", F.inline(F.array(chord(20000 + j, zero, j, j + 1))))
    new = big.unionByName(little).withColumnRenamed("region_a", "region_id").drop("region_b")
    return regions, arcs, old, new


NESTED_SQL = f"""
a AS (SELECT CAST(l_suppkey AS BIGINT) AS map_id, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER)}) - 1 AS j, count(*) OVER (PARTITION BY l_suppkey) AS m FROM lineitem),
new AS (SELECT map_id, 10000 + j AS chord_id, j AS lo, m - 1 - j AS hi, CAST(q AS DOUBLE) AS y FROM a WHERE j % 2 = 0 AND 2 * j < m - 1 UNION ALL SELECT map_id, 20000 + j, j, j + 1, CAST(q AS DOUBLE) FROM a WHERE j % 4 = 0 AND 2 * (j + 3) < m),
base AS (SELECT map_id, coalesce(max(j + 1) FILTER (j % 6 = 1), 0) AS base FROM a GROUP BY map_id),
own AS (SELECT new.*, base + row_number() OVER (PARTITION BY new.map_id ORDER BY chord_id) AS own FROM new JOIN base USING (map_id)),
held AS (SELECT a.map_id, a.j, a.q, coalesce((SELECT arg_min(own, hi - lo) FROM own WHERE own.map_id = a.map_id AND lo <= a.j AND a.j <= hi), 0) AS region_id FROM a),
up AS (SELECT x.map_id, x.chord_id, x.own, x.lo, x.hi, x.y, coalesce((SELECT arg_min(o.own, o.hi - o.lo) FROM own o WHERE o.map_id = x.map_id AND o.lo <= x.lo AND x.hi <= o.hi AND o.hi - o.lo > x.hi - x.lo), 0) AS outer_ FROM own x)"""
