"""Registered queries of the planar operators, one or more for each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.plane import orient2d, x_at
from .operators import chains, quality, rings, triangulation, visibility
from .plans.fixtures import ORDER, skyline_sql, skylines
from .plans.iterate import cut, scratch
from .sources import tables

QUERIES: dict = {}
ORACLES: dict = {}
SKY = "WITH " + skyline_sql()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _poly(sql: str):
    """A query over the skyline vertices."""
    return SKY + sql


# Vertices and rings


@query("s1_read_polygon_text", "WITH " + skyline_sql("l_suppkey") + " SELECT pid, idx, x, y FROM v")
def _s1(s, d):
    """The polygons by supplier, written as a text file each (n, then lines "x y") and read back."""
    path = scratch(s, "polygons")
    line = F.concat_ws(" ", "x", "y")
    ring = skylines(s, d, "l_suppkey").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("v"))
    ring.select("pid", F.concat_ws("\n", F.size("v").cast("string"), F.col("v.line")).alias("value")).repartition("pid").write.partitionBy("pid").text(path)
    names = s.read.text(path, wholetext=True).select(F.input_file_name().alias("path")).select(F.xxhash64("path").alias("file"), F.regexp_extract("path", r"pid=(\d+)", 1).cast("long").alias("pid"))
    return tables.read_polygon_text(s, path)[0].withColumnRenamed("pid", "file").join(names, "file").select("pid", "idx", "x", "y")


query("s2_read_vertices", _poly("SELECT pid, idx, x, y FROM v"))(lambda s, d: tables.read_vertices(skylines(s, d).withColumnsRenamed({"pid": "p", "idx": "i"}), "p", "i"))


def _points(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("pid"), F.struct(*ORDER).alias("pos"), F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))


query("v1_validate_polygons", "SELECT l_orderkey AS pid, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) < 3")(lambda s, d: rings.validate_polygons(_points(s, d))[1].groupBy("pid").agg(F.count("*").alias("n")))
query("v2_index_vertices", f"SELECT l_orderkey AS pid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) - 1 AS idx, CAST(l_quantity AS DOUBLE) AS y FROM lineitem")(lambda s, d: rings.index_vertices(_points(s, d), "pos").select("pid", "idx", "y"))
query("v3_ring_neighbors", _poly("SELECT pid, idx, prev_idx, next_idx, prev_y, next_y, n FROM ring"))(lambda s, d: rings.ring_neighbors(skylines(s, d)).select("pid", "idx", "prev_idx", "next_idx", "prev_y", "next_y", "n"))
query("v4_ring_edges", _poly("SELECT pid, idx AS e, idx AS a, next_idx AS b FROM ring"))(lambda s, d: rings.ring_edges(skylines(s, d)))
query("v4_open_edges", _poly("SELECT pid, idx AS e, idx AS a, idx + 1 AS b FROM ring WHERE idx < n - 1"))(lambda s, d: rings.ring_edges(skylines(s, d), closed=False))
_PAD = """, p AS (SELECT *, CAST(1 << CAST(ceil(log2(n - 1)) AS INTEGER) AS BIGINT) + 1 AS size FROM ring),
pad AS (SELECT pid, idx, x, y FROM p WHERE idx < n - 1 UNION ALL SELECT pid, size - 1, x, y FROM p WHERE idx = n - 1
UNION ALL SELECT pid, idx + j, x + j / (size - n + 1) * (next_x - x), y + j / (size - n + 1) * (next_y - y) FROM p, range(1, size - n + 1) AS t(j) WHERE idx = n - 2) """
query("v5_pad_ring", _poly(_PAD.replace("range(1, size - n + 1) AS t(j)", "LATERAL (SELECT unnest(range(1, size - n + 1)) AS j)") + "SELECT pid, idx, x, y FROM pad"))(lambda s, d: rings.pad_ring(skylines(s, d)))


@query("v6_unpad_index", _poly(_PAD.replace("range(1, size - n + 1) AS t(j)", "LATERAL (SELECT unnest(range(1, size - n + 1)) AS j)") + ", m AS (SELECT pid, any_value(n) AS n, any_value(size) AS size FROM p GROUP BY pid) SELECT pad.pid, idx, CASE WHEN idx <= n - 2 THEN idx WHEN idx - (n - 2) <= (size - n) // 2 THEN n - 2 ELSE n - 1 END AS original FROM pad JOIN m USING (pid)"))
def _v6(s, d):
    v = skylines(s, d)
    n = v.groupBy("pid").agg(F.count("*").alias("n"))
    p = rings.pad_ring(v)
    size = p.groupBy("pid").agg(F.count("*").alias("size"))
    return rings.unpad_index(p.join(n, "pid").join(size, "pid")).select("pid", "idx", "original")


query("v7_y_rank", _poly("SELECT pid, idx, rk FROM r"))(lambda s, d: rings.y_rank(skylines(s, d)).select("pid", "idx", "rk"))


@query("v8_y_compare", _poly("SELECT pid, idx, CASE WHEN rk < next_rk THEN -1 ELSE 1 END AS cmp, rk < next_rk AS less FROM ring"))
def _v8(s, d):
    r = rings.ring_neighbors(skylines(s, d))
    return rings.compare_points(r.select("pid", "idx", F.col("y").alias("a_y"), F.col("x").alias("a_x"), F.col("idx").alias("a_idx"), F.col("next_y").alias("b_y"), F.col("next_x").alias("b_x"), F.col("next_idx").alias("b_idx"))).select("pid", "idx", "cmp", "less")


_KIND = "CASE WHEN rk < prev_rk AND rk < next_rk THEN 'min' WHEN rk > prev_rk AND rk > next_rk THEN 'max' ELSE 'neither' END"
query("v9_y_extrema", _poly(f"SELECT pid, idx, CASE WHEN idx = 0 OR idx = n - 1 THEN 'neither' ELSE {_KIND} END AS kind FROM ring"))(lambda s, d: rings.y_extrema(skylines(s, d)).select("pid", "idx", "kind"))
_TURN = "(x - prev_x) * (next_y - prev_y) - (y - prev_y) * (next_x - prev_x)"
query("v10_orient2d", _poly("SELECT pid, idx, (next_x - x) * (prev_y - y) - (next_y - y) * (prev_x - x) AS turn FROM ring"))(lambda s, d: rings.ring_neighbors(skylines(s, d)).select("pid", "idx", orient2d("x", "y", "next_x", "next_y", "prev_x", "prev_y").alias("turn")))
query("v11_vertex_convexity", _poly(f"SELECT pid, idx, {_TURN} AS turn, CASE WHEN {_TURN} > 0 THEN 'convex' WHEN {_TURN} < 0 THEN 'reflex' ELSE 'collinear' END AS kind FROM ring"))(lambda s, d: rings.vertex_convexity(skylines(s, d)).select("pid", "idx", "turn", "kind"))
query("v12_ray_x_intercept", _poly("SELECT pid, idx, CASE WHEN y <> next_y THEN x + ((y + next_y) / 2 - y) * ((next_x - x) / (next_y - y)) END AS hit_x FROM ring"))(lambda s, d: rings.ring_neighbors(skylines(s, d)).select("pid", "idx", x_at("x", "y", "next_x", "next_y", (F.col("y") + F.col("next_y")) / 2).alias("hit_x")))
query("v13_edge_x_at_y", _poly("SELECT pid, idx AS e, y, CASE WHEN y <> next_y THEN x ELSE (x + next_x) / 2 END AS hit_x FROM ring UNION ALL SELECT pid, n AS e, y, NULL FROM ring WHERE idx = 0"))(
    lambda s, d: rings.edge_x_at_y((v := skylines(s, d)).select("pid", F.col("idx").alias("e"), "y").unionByName(v.groupBy("pid").agg(F.count("*").alias("e"), F.min("y").alias("y"))), v).select("pid", "e", "y", "hit_x")
)
query("v14_is_endpoint", _poly("SELECT pid, idx FROM ring WHERE idx = 0 OR idx = n - 1"))(lambda s, d: rings.ring_neighbors(skylines(s, d)).where(rings.is_endpoint()).select("pid", "idx"))
query("v15_signed_area", _poly("SELECT pid, sum(x * next_y - next_x * y) AS area2 FROM ring GROUP BY pid"))(lambda s, d: rings.signed_area(skylines(s, d)))
query("v15_orient_ccw", _poly("SELECT pid, idx, x, y FROM v"))(
    lambda s, d: rings.orient_ccw(rings.ring_neighbors(skylines(s, d)).withColumn("idx", F.when(F.col("pid") % 2 == 0, F.pmod(F.col("n") - F.col("idx"), F.col("n"))).otherwise(F.col("idx"))).select("pid", "idx", "x", "y"))
)

# Chains


@query("c1_chain_ranges", _poly("""SELECT g.pid, g.grade, chain, chain * (1 << g.grade) AS start_vertex, (chain + 1) * (1 << g.grade) AS end_vertex, CAST(pow(2, ceil(g.grade / 5.0)) AS BIGINT) AS granularity
FROM (SELECT pid, p, unnest(range(p + 1)) AS grade FROM (SELECT pid, CAST(ceil(log2(any_value(n) - 1)) AS BIGINT) AS p FROM ring GROUP BY pid)) g, LATERAL (SELECT unnest(range(CAST(1 << (g.p - g.grade) AS BIGINT))) AS chain)"""))
def _c1(s, d):
    g = skylines(s, d).groupBy("pid").agg(F.count("*").alias("n")).select("pid", F.ceil(F.log2(F.col("n") - 1)).alias("p"))
    return chains.chain_ranges(g).select("pid", F.col("grade").cast("long").alias("grade"), "chain", "start_vertex", "end_vertex", "granularity")


@query("c3_dyadic_cut", """WITH q AS (SELECT l_orderkey AS range_id, min(l_linenumber) AS s, max(l_linenumber) + 1 AS e FROM lineitem GROUP BY 1)
SELECT range_id, CAST(k AS BIGINT) AS grade, l AS chain, l << k AS start, (l + 1) << k AS "end" FROM q, (SELECT unnest(range(8)) AS k), (SELECT unnest(range(64)) AS l)
WHERE (l << k) >= s AND ((l + 1) << k) <= e AND NOT ((l // 2) << (k + 1) >= s AND (l // 2 + 1) << (k + 1) <= e)""")
def _c3(s, d):
    r = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("range_id")).agg(F.min("l_linenumber").cast("long").alias("s"), (F.max("l_linenumber") + 1).cast("long").alias("e"))
    return chains.dyadic_cut(r).withColumn("grade", F.col("grade").cast("long"))


# Visibility

_SHOT = """, e AS (SELECT pid, idx AS e, x AS ax, y AS ay, next_x AS bx, next_y AS by_, least(rk, next_rk) AS lo, greatest(rk, next_rk) AS hi FROM ring),
pairs AS MATERIALIZED (SELECT a.pid, a.idx, a.x, e.e, e.ax + (a.y - e.ay) * ((e.bx - e.ax) / (e.by_ - e.ay)) AS xi, (e.bx - e.ax) / (e.by_ - e.ay) AS slope FROM ring a JOIN e ON a.pid = e.pid AND e.lo < a.rk AND a.rk < e.hi),
ranked AS MATERIALIZED (SELECT *, CASE WHEN xi <= x THEN row_number() OVER (PARTITION BY pid, idx, xi <= x ORDER BY xi DESC, slope DESC) END AS nl, CASE WHEN xi >= x THEN row_number() OVER (PARTITION BY pid, idx, xi >= x ORDER BY xi, slope DESC) END AS nr FROM pairs),
shot AS MATERIALIZED (SELECT ring.*, l.e AS hl, l.xi AS hl_x, t.e AS hr, t.xi AS hr_x FROM ring LEFT JOIN (SELECT * FROM ranked WHERE nl = 1) l ON l.pid = ring.pid AND l.idx = ring.idx LEFT JOIN (SELECT * FROM ranked WHERE nr = 1) t ON t.pid = ring.pid AND t.idx = ring.idx) """
query("r1_ray_shoot", _poly(_SHOT + "SELECT pid, idx, hl, hl_x, hr, hr_x FROM shot"))(lambda s, d: visibility.ray_shoot(skylines(s, d)).select("pid", "idx", "hl", "hl_x", "hr", "hr_x"))
query("r1_ray_shoot_dyadic", _poly(_SHOT + "SELECT pid, idx, hl, hl_x, hr, hr_x FROM shot"))(lambda s, d: visibility.ray_shoot(skylines(s, d), small=0).select("pid", "idx", "hl", "hl_x", "hr", "hr_x"))
_FREE = """, e AS (SELECT pid, idx AS e, x AS ax, y AS ay, next_x AS bx, next_y AS by_ FROM ring), rays AS ({rays}),
pairs AS (SELECT a.pid, a.ray_id, a.x, e.e, e.ax + (a.y - e.ay) * ((e.bx - e.ax) / (e.by_ - e.ay)) AS xi, (e.bx - e.ax) / (e.by_ - e.ay) AS slope FROM rays a JOIN e ON a.pid = e.pid AND least(ay, by_) <= a.y AND a.y < greatest(ay, by_){more}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid, ray_id ORDER BY xi DESC, slope DESC) AS k FROM pairs WHERE xi <= x) WHERE k = 1),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid, ray_id ORDER BY xi, slope DESC) AS k FROM pairs WHERE xi >= x) WHERE k = 1)
SELECT rays.pid, rays.ray_id, l.e AS hl, l.xi AS hl_x, t.e AS hr, t.xi AS hr_x FROM rays LEFT JOIN l ON l.pid = rays.pid AND l.ray_id = rays.ray_id LEFT JOIN t ON t.pid = rays.pid AND t.ray_id = rays.ray_id"""
query("r2_shoot_from_edge", _poly(_FREE.format(rays="SELECT pid, idx AS ray_id, idx AS own, CASE WHEN y <> next_y THEN x + ((y + next_y) / 2 - y) * ((next_x - x) / (next_y - y)) ELSE (x + next_x) / 2 END AS x, (y + next_y) / 2 AS y FROM ring", more=" AND e.e <> a.own")))(
    lambda s, d: visibility.shoot_from_edge(rings.ring_neighbors(v := skylines(s, d)).select("pid", F.col("idx").alias("ray_id"), F.col("idx").alias("e"), ((F.col("y") + F.col("next_y")) / 2).alias("y")), v).select("pid", "ray_id", "hl", "hl_x", "hr", "hr_x")
)
query("r3_shoot_from_point", _poly(_FREE.format(rays="SELECT pid, idx AS ray_id, x + 0.5 AS x, y / 2 AS y FROM v", more="")))(lambda s, d: visibility.shoot_from_point((v := skylines(s, d)).select("pid", F.col("idx").alias("ray_id"), (F.col("x") + 0.5).alias("x"), (F.col("y") / 2).alias("y")), v))


@query("r4_shoot_chords", _poly("""SELECT a.pid, a.idx AS ray_id, 'CHORD' AS hit_type, b.idx AS hit_id, b.x + 0.25 AS hit_x FROM v a JOIN v b ON a.pid = b.pid AND b.y = a.y AND b.x + 0.25 >= a.x AND a.idx > 1 AND b.idx > 1
QUALIFY row_number() OVER (PARTITION BY a.pid, a.idx ORDER BY b.x + 0.25 - a.x, b.idx) = 1"""))
def _r4(s, d):
    v = skylines(s, d).where("idx > 1")
    rays = v.select("pid", F.col("idx").alias("ray_id"), "x", "y", F.lit("R").alias("side"))
    chords = v.select("pid", F.col("idx").alias("chord_id"), "y", (F.col("x") + 0.25).alias("x1"), (F.col("x") + 0.75).alias("x2"))
    hits = rays.select("pid", "ray_id", F.lit(None).cast("long").alias("e"), F.lit(None).cast("double").alias("hit_x"))
    return visibility.shoot_chords(rays, chords, hits)


@query("r5_cross_chain", _poly(""", e AS (SELECT pid, idx AS e, CASE WHEN idx < n // 2 THEN 0 ELSE 1 END AS c, x AS ax, y AS ay, next_x AS bx, next_y AS by_, least(rk, next_rk) AS lo, greatest(rk, next_rk) AS hi FROM ring WHERE next_idx > idx),
pairs AS (SELECT a.pid, a.idx, a.x, e.e, CASE WHEN a.idx < a.n // 2 THEN 0 ELSE 1 END <> c AS other, e.ax + (a.y - e.ay) * ((e.bx - e.ax) / (e.by_ - e.ay)) AS xi, (e.bx - e.ax) / (e.by_ - e.ay) AS slope FROM ring a JOIN e ON a.pid = e.pid AND e.lo < a.rk AND a.rk < e.hi),
l AS (SELECT *, row_number() OVER (PARTITION BY pid, idx ORDER BY xi DESC, slope DESC) AS k FROM pairs WHERE xi <= x AND other), lo AS (SELECT pid, idx, max(xi) AS m FROM pairs WHERE xi <= x AND NOT other GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY pid, idx ORDER BY xi, slope DESC) AS k FROM pairs WHERE xi >= x AND other), ro AS (SELECT pid, idx, min(xi) AS m FROM pairs WHERE xi >= x AND NOT other GROUP BY 1, 2)
SELECT l.pid, l.idx, 'L' AS side, e FROM l LEFT JOIN lo ON l.pid = lo.pid AND l.idx = lo.idx WHERE k = 1 AND (m IS NULL OR xi >= m) UNION ALL SELECT t.pid, t.idx, 'R', e FROM t LEFT JOIN ro ON t.pid = ro.pid AND t.idx = ro.idx WHERE k = 1 AND (m IS NULL OR xi <= m)"""))
def _r5(s, d):
    v = rings.ring_neighbors(skylines(s, d), ("idx",)).select("pid", "idx", "x", "y", F.when(F.col("idx") < F.floor(F.col("n") / 2), 0).otherwise(1).alias("chain"))
    return visibility.cross_chain_visibility(v, "chain")


query("r6_visibility_chords", _poly(_SHOT + "SELECT pid, idx AS vertex, y, 'L' AS side, hl AS left_edge, idx AS right_edge FROM shot WHERE hl IS NOT NULL UNION ALL SELECT pid, idx, y, 'R', idx, hr FROM shot WHERE hr IS NOT NULL"))(lambda s, d: visibility.visibility_chords(skylines(s, d)))
query("r7_null_length_chords", _poly(f"SELECT pid, idx AS vertex, y, idx AS left_edge, idx AS right_edge, TRUE AS is_null_length FROM ring WHERE {_KIND} <> 'neither'"))(lambda s, d: visibility.null_length_chords(skylines(s, d)))
_TRAPS = _SHOT + f""", o AS (SELECT *, {_TURN} AS turn, prev_rk > rk AS pa, next_rk > rk AS na FROM shot),
ev AS (
SELECT pid, idx, rk, FALSE AS begins, prev_idx AS le, hr AS re FROM o WHERE pa AND NOT na UNION ALL SELECT pid, idx, rk, TRUE, idx, hr FROM o WHERE pa AND NOT na
UNION ALL SELECT pid, idx, rk, FALSE, hl, idx FROM o WHERE NOT pa AND na UNION ALL SELECT pid, idx, rk, TRUE, hl, prev_idx FROM o WHERE NOT pa AND na
UNION ALL SELECT pid, idx, rk, TRUE, idx, prev_idx FROM o WHERE NOT pa AND NOT na AND turn > 0
UNION ALL SELECT pid, idx, rk, FALSE, hl, hr FROM o WHERE NOT pa AND NOT na AND turn <= 0 UNION ALL SELECT pid, idx, rk, TRUE, hl, prev_idx FROM o WHERE NOT pa AND NOT na AND turn <= 0 UNION ALL SELECT pid, idx, rk, TRUE, idx, hr FROM o WHERE NOT pa AND NOT na AND turn <= 0
UNION ALL SELECT pid, idx, rk, FALSE, prev_idx, idx FROM o WHERE pa AND na AND turn > 0
UNION ALL SELECT pid, idx, rk, FALSE, hl, idx FROM o WHERE pa AND na AND turn <= 0 UNION ALL SELECT pid, idx, rk, FALSE, prev_idx, hr FROM o WHERE pa AND na AND turn <= 0 UNION ALL SELECT pid, idx, rk, TRUE, hl, hr FROM o WHERE pa AND na AND turn <= 0),
traps AS (SELECT a.pid, a.idx AS top_v, arg_max(b.idx, b.rk) AS bottom_v, a.le AS left_edge, a.re AS right_edge FROM ev a JOIN ev b ON a.pid = b.pid AND a.le = b.le AND a.re = b.re AND b.rk < a.rk AND NOT b.begins WHERE a.begins GROUP BY a.pid, a.idx, a.le, a.re) """
query("r8_trapezoids", _poly(_TRAPS + "SELECT pid, top_v, bottom_v, left_edge, right_edge FROM traps"))(lambda s, d: visibility.trapezoids(skylines(s, d)))


@query("r9_locate_by_height", _poly(", c AS (SELECT pid, y, idx AS above, idx + 1000 AS below FROM v QUALIFY row_number() OVER (PARTITION BY pid, y ORDER BY idx) = 1) SELECT v.pid AS map_id, v.idx AS query_id, coalesce((arg_max(c.above, c.y) FILTER (c.y < v.y)), arg_min(c.below, c.y)) AS region FROM v JOIN c ON v.pid = c.pid GROUP BY v.pid, v.idx"))
def _r9(s, d):
    v = cut(skylines(s, d))
    c = v.groupBy("pid", "y").agg(F.min("idx").alias("above")).select(F.col("pid").alias("map_id"), "y", "above", (F.col("above") + 1000).alias("below"))
    return visibility.locate_by_height(v.select(F.col("pid").alias("map_id"), F.col("idx").alias("query_id"), "y"), c)


# Triangulation

_BOTH = "abs(top_v - bottom_v) IN (1, n - 1)"
_N = ", nn AS (SELECT pid, count(*) AS n FROM v GROUP BY pid) "
query("t1_classify_trapezoids", _poly(_TRAPS + _N + f"SELECT pid, top_v, bottom_v, CASE WHEN {_BOTH} THEN 'A' ELSE 'B' END AS class FROM traps JOIN nn USING (pid)"))(lambda s, d: triangulation.classify_trapezoids(visibility.trapezoids(v := skylines(s, d)), v).select("pid", "top_v", "bottom_v", "class"))
_DIAG = _TRAPS + _N + f", dg AS (SELECT DISTINCT pid, least(top_v, bottom_v) AS u, greatest(top_v, bottom_v) AS w FROM traps JOIN nn USING (pid) WHERE NOT {_BOTH}) "
query("t1_diagonals", _poly(_DIAG + "SELECT pid, u, w AS v FROM dg"))(lambda s, d: triangulation.diagonals(visibility.trapezoids(v := skylines(s, d)), v))


def _pieces(s, d):
    v = cut(skylines(s, d))
    few, many = triangulation.pieces(v, triangulation.diagonals(visibility.trapezoids(v), v))
    return few if many is None else few.unionByName(many)


query("t2_split_by_diagonals", _poly(_DIAG + "SELECT nn.pid, n + 2 * count(dg.u) AS corners, count(dg.u) + 1 AS pieces FROM nn LEFT JOIN dg USING (pid) GROUP BY nn.pid, n"))(lambda s, d: _pieces(s, d).groupBy("pid").agg(F.count("*").alias("corners"), F.count_distinct("piece").alias("pieces")))
query("t3_mountain_base", _poly(_DIAG + "SELECT nn.pid, count(dg.u) + 1 AS mountains FROM nn LEFT JOIN dg USING (pid) GROUP BY nn.pid"))(lambda s, d: triangulation.mountain_base(_pieces(s, d)).where("direction is not null").groupBy("pid").agg(F.count("*").alias("mountains")))
_AREA = _poly("SELECT pid, any_value(n) - 2 AS triangles, sum(x * next_y - next_x * y) AS area2 FROM ring GROUP BY pid")


def _areas(t: DataFrame, v: DataFrame) -> DataFrame:
    return quality.check_area(t, v).join(t.groupBy("pid").agg(F.count("*").alias("triangles")), "pid").select("pid", "triangles", F.col("triangles2").alias("area2"))


query("t4_triangulate_monotone", _AREA)(lambda s, d: _areas(cut(triangulation.triangulate_monotone(cut(_pieces(s, d)), small=12)), skylines(s, d)))
query("t5_triangulate", _AREA)(lambda s, d: _areas(cut(triangulation.triangulate(v := cut(skylines(s, d)))), v))
query("t6_triangulate_with", _AREA)(lambda s, d: _areas(cut(triangulation.triangulate_with(v := cut(skylines(s, d)), visibility.trapezoids(v))[0]), v))
query("t7_ring_fan", _poly("SELECT pid, CAST(0 AS BIGINT) AS a, idx AS b, idx + 1 AS c FROM ring WHERE idx BETWEEN 1 AND n - 2"))(lambda s, d: triangulation.ring_fan(skylines(s, d)))


@query("s4_write_triangles", _poly("SELECT pid, CAST(0 AS BIGINT) AS a, idx AS b, idx + 1 AS c FROM ring WHERE idx BETWEEN 1 AND n - 2"))
def _s4(s, d):
    """Fans written as lines "pid a b c" and read back."""
    path = scratch(s, "triangles")
    tables.write_triangles(triangulation.ring_fan(skylines(s, d)), path, text=True, folders=False)
    return s.read.csv(path, sep=" ", schema="pid long, a long, b long, c long")


@query("s5_polygon_report", _poly("SELECT pid, any_value(n) AS vertices, any_value(n) AS edges, any_value(n) - 1 AS trapezoids, CAST(1 << CAST(ceil(log2(any_value(n) - 1)) AS INTEGER) AS BIGINT) + 1 AS padded FROM ring GROUP BY pid"))
def _s5(s, d):
    v = skylines(s, d)
    return tables.polygon_report(vertices=v, edges=rings.ring_edges(v), trapezoids=visibility.trapezoids(v), padded=rings.pad_ring(v))


# Checks of triangulations: fans with broken copies

_FAN = ", fan AS (SELECT pid, 0 AS a, idx AS b, idx + 1 AS c FROM ring WHERE idx BETWEEN 1 AND n - 2), bad AS (SELECT * FROM fan UNION ALL SELECT pid, 0, b, b FROM fan WHERE b = 1 UNION ALL SELECT pid, 0, b, c + 100000 FROM fan WHERE b = 2 UNION ALL SELECT pid, a, b, c FROM fan WHERE b = 1 UNION ALL SELECT pid, a, b, c FROM fan WHERE b = 1) "


def _bad(v):
    f = triangulation.ring_fan(v)
    one, two = f.where("b = 1"), f.where("b = 2")
    return f.unionByName(one.withColumn("c", F.col("b"))).unionByName(two.withColumn("c", F.col("c") + 100000)).unionByName(one).unionByName(one)


query("q1_check_triangle_ids", _poly(_FAN + _N + "SELECT pid, CAST(a AS BIGINT) AS a, b, c FROM bad JOIN nn USING (pid) WHERE a < 0 OR b < 0 OR c < 0 OR a >= n OR b >= n OR c >= n OR a = b OR b = c OR a = c"))(lambda s, d: quality.check_triangle_ids(_bad(v := skylines(s, d)), v))
query("q2_check_edge_use", _poly(_FAN + ", ed AS (SELECT pid, least(a, b) AS u, greatest(a, b) AS v FROM bad UNION ALL SELECT pid, least(b, c), greatest(b, c) FROM bad UNION ALL SELECT pid, least(a, c), greatest(a, c) FROM bad) SELECT pid, u, v, count(*) AS uses FROM ed GROUP BY 1, 2, 3 HAVING count(*) > 2"))(lambda s, d: quality.check_edge_use(_bad(skylines(s, d))))
query("q3_check_coverage", _poly("SELECT pid, idx FROM ring WHERE idx = n - 1"))(lambda s, d: quality.check_coverage(triangulation.ring_fan(v := skylines(s, d)).join(v.groupBy("pid").agg(F.count("*").alias("n")), "pid").where("c < n - 1"), v))
query("q4_check_count", _poly(_FAN + _N + "SELECT pid, n, count(*) AS triangles FROM bad JOIN nn USING (pid) GROUP BY pid, n HAVING count(*) <> n - 2"))(lambda s, d: quality.check_count(_bad(v := skylines(s, d)), v))
query("q9_check_area", _poly(", f AS (SELECT a.pid, abs((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS t FROM ring b JOIN v a ON a.pid = b.pid AND a.idx = 0 JOIN v c ON c.pid = b.pid AND c.idx = b.idx + 1 WHERE b.idx BETWEEN 1 AND b.n - 2) SELECT r2.pid, area2, triangles2 FROM (SELECT pid, sum(x * next_y - next_x * y) AS area2 FROM ring GROUP BY pid) r2 JOIN (SELECT pid, sum(t) AS triangles2 FROM f GROUP BY pid) USING (pid)"))(lambda s, d: quality.check_area(triangulation.ring_fan(v := skylines(s, d)), v))


@query("q10_check_simple", _poly(""", w AS MATERIALIZED (SELECT pid, CASE idx WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE idx END AS idx, x, y, n FROM ring), e AS MATERIALIZED (SELECT a.pid, a.idx AS e, a.x, a.y, b.x AS u, b.y AS z FROM w a JOIN w b ON a.pid = b.pid AND b.idx = (a.idx + 1) % a.n),
crossing AS MATERIALIZED (SELECT a.pid, a.e, b.e AS other FROM e a JOIN e b ON a.pid = b.pid AND a.e < b.e
WHERE sign((a.u - a.x) * (b.y - a.y) - (a.z - a.y) * (b.x - a.x)) * sign((a.u - a.x) * (b.z - a.y) - (a.z - a.y) * (b.u - a.x)) < 0 AND sign((b.u - b.x) * (a.y - b.y) - (b.z - b.y) * (a.x - b.x)) * sign((b.u - b.x) * (a.z - b.y) - (b.z - b.y) * (a.u - b.x)) < 0) SELECT * FROM crossing"""))
def _q10(s, d):
    v = skylines(s, d)
    return quality.check_simple(v.withColumn("idx", F.when(F.col("idx") == 2, 3).when(F.col("idx") == 3, 2).otherwise(F.col("idx"))))
