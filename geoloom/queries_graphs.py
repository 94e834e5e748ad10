"""Registered queries of the region and graph operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import darts, graphs, quality, regions, rings, triangulation, visibility
from .plans.fixtures import BLOCK, GRID_SQL, REGION_SQL, STACK, WIDTH, grid, region_map, skyline_sql, skylines, stacked
from .plans.iterate import cut
from .queries import query
from .sources import tables

REG = "WITH " + REGION_SQL
GRID = "WITH RECURSIVE " + GRID_SQL

# Regions

_W = ", w AS (SELECT r.map_id, r.region_id, coalesce(max(edge_count), 0) AS weight FROM regions r LEFT JOIN arcs USING (map_id, region_id) GROUP BY 1, 2), deg AS (SELECT r.map_id, r.region_id, count(c.chord_id) AS degree FROM regions r LEFT JOIN chords c ON c.map_id = r.map_id AND r.region_id IN (c.region_a, c.region_b) GROUP BY 1, 2) "
query("m1_region_weight", REG + _W + "SELECT * FROM w")(lambda s, d: regions.region_weight(*region_map(s, d)[:2]))
query("m2_region_degree", REG + _W + "SELECT * FROM deg")(lambda s, d: regions.region_degree((m := region_map(s, d))[0], m[2]))
query("m3_map_flags", REG + _W + "SELECT map_id, max(degree) AS max_degree, bool_and(degree <= 4) AS is_conformal, bool_and(weight <= 9) AS is_semigranular, count(*) FILTER (weight = 0) AS empty_regions FROM w JOIN deg USING (map_id, region_id) GROUP BY 1")(lambda s, d: regions.map_flags(*region_map(s, d), 9))
query("m4_arc_flags", REG + "SELECT map_id, arc_id, edge_count = 0 AS is_null, edge_count = 1 AND first_edge = last_edge AS is_single, FALSE AS is_virtual FROM arcs")(lambda s, d: regions.arc_flags(region_map(s, d)[1]).select("map_id", "arc_id", "is_null", "is_single", "is_virtual"))


@query("m5_contract_chords", REG + """, low AS (SELECT r.map_id, r.region_id, (SELECT coalesce(max(c.region_b), 0) FROM chords c WHERE c.map_id = r.map_id AND c.chord_id % 2 = 1 AND c.region_b <= r.region_id) AS low FROM regions r),
used AS (SELECT k.map_id, low, unnest([left_edge, right_edge]) AS e FROM chords k JOIN low ON low.map_id = k.map_id AND low.region_id IN (region_a, region_b) WHERE chord_id % 2 = 1),
gone AS (SELECT k.map_id, low, unnest([left_edge, right_edge]) AS e FROM chords k JOIN low ON low.map_id = k.map_id AND low.region_id = region_a WHERE chord_id % 2 = 0 EXCEPT SELECT map_id, low, e FROM used),
run AS (SELECT arcs.map_id, low.low, first_side, arc_id, first_edge, last_edge, edge_count, CASE WHEN gone.e IS NOT NULL AND first_edge - lag(last_edge) OVER w IN (0, 1) THEN 0 ELSE 1 END AS new FROM arcs JOIN low USING (map_id, region_id) LEFT JOIN gone ON gone.map_id = arcs.map_id AND gone.low = low.low AND gone.e = first_edge WINDOW w AS (PARTITION BY arcs.map_id, low.low, first_side ORDER BY first_edge, arc_id)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY map_id, low, first_side ORDER BY first_edge, arc_id) AS run FROM run)
SELECT map_id, low AS region_id, min(arc_id) AS arc_id, min(first_edge) AS first_edge, max(last_edge) AS last_edge, CAST(sum(edge_count) AS BIGINT) AS edge_count, CAST(max(sum(edge_count)) OVER (PARTITION BY map_id, low) AS BIGINT) AS weight FROM runs GROUP BY map_id, low, first_side, run""")
def _m5(s, d):
    """Arcs after every other chord has gone, with their regions' weights."""
    r, a, c = map(cut, region_map(s, d))
    weights, glued, _ = regions.contract_chords(r, a, c, c.where("chord_id % 2 = 0").select("map_id", "chord_id"))
    return glued.join(weights, ["map_id", "region_id"]).select("map_id", "region_id", "arc_id", "first_edge", "last_edge", "edge_count", "weight")


@query("m6_coarsen", REG + "SELECT DISTINCT map_id, TRUE AS bounded, TRUE AS maximal FROM regions")
def _m6(s, d):
    """Whether weights stay within gamma, and no chord is left that could go."""
    gamma = 25
    r, a, c = regions.coarsen(*map(cut, region_map(s, d)), gamma)
    left = regions.merged_weights(r, a, c).where((F.least("da", "db") < 3) & (F.col("merged") <= gamma)).groupBy("map_id").agg(F.count("*").alias("left_"))
    return regions.region_weight(r, a).groupBy("map_id").agg((F.max("weight") <= gamma).alias("bounded")).join(left, "map_id", "left").select("map_id", "bounded", F.col("left_").isNull().alias("maximal"))


query("m7_split_ranges", REG + ", q AS (SELECT map_id, chord_id AS range_id, lo AS s, hi AS e FROM ch), e2 AS (SELECT q.map_id, range_id, first_edge AS fin FROM q JOIN arcs USING (map_id) WHERE s <= first_edge AND first_edge < e UNION SELECT map_id, range_id, e FROM q) SELECT e2.map_id, e2.range_id, coalesce(lag(fin) OVER (PARTITION BY e2.map_id, e2.range_id ORDER BY fin) + 1, s) AS s, fin AS e FROM e2 JOIN q USING (map_id, range_id)")(
    lambda s, d: regions.split_ranges((m := region_map(s, d))[2].select("map_id", F.col("chord_id").alias("range_id"), F.least("left_edge", "right_edge").alias("s"), F.greatest("left_edge", "right_edge").alias("e")), m[1].select("map_id", F.col("first_edge").alias("edge")))
)
query("m8_assign_arcs", REG + "SELECT arcs.map_id, arcs.arc_id, (SELECT count(*) FROM ch WHERE ch.map_id = arcs.map_id AND ch.lo <= arcs.first_edge) AS region FROM arcs")(lambda s, d: regions.assign_arcs((m := region_map(s, d))[1].select("map_id", "arc_id", F.col("first_edge").alias("key")), m[2].select("map_id", F.least("left_edge", "right_edge").alias("key"))))
_HIT = ", hit AS (SELECT q.map_id, q.query_id, arcs.region_id, arcs.arc_id, row_number() OVER (PARTITION BY q.map_id, q.query_id, arcs.region_id ORDER BY CASE WHEN first_edge < q.e AND q.e < last_edge THEN 0 ELSE 1 END, arcs.arc_id) AS k FROM ({q}) q JOIN arcs ON arcs.map_id = q.map_id AND first_edge <= q.e AND q.e <= last_edge) "
query("m9_locate_on_arcs", REG + _HIT.format(q="SELECT map_id, chord_id AS query_id, left_edge AS e FROM chords") + "SELECT map_id, query_id, region_id, arc_id FROM hit WHERE k = 1")(lambda s, d: regions.locate_on_arcs((m := region_map(s, d))[2].select("map_id", F.col("chord_id").alias("query_id"), F.col("left_edge").alias("e")), m[1]))
query("r10_region_locate_on_edge", REG + "SELECT c.map_id, c.chord_id AS query_id, min(arcs.region_id) AS region FROM chords c LEFT JOIN arcs ON arcs.map_id = c.map_id AND first_edge <= left_edge AND left_edge <= last_edge AND first_side = 'L' GROUP BY 1, 2")(
    lambda s, d: visibility.region_locate_on_edge((m := region_map(s, d))[2].select("map_id", F.col("chord_id").alias("query_id"), F.col("left_edge").alias("e"), F.lit("L").alias("side")), m[1])
)
query("m10_canonical_arcs", REG + "SELECT map_id, arc_id, row_number() OVER (PARTITION BY map_id ORDER BY first_side, CASE WHEN first_side = 'L' THEN first_edge ELSE -first_edge END, arc_id) - 1 AS place, first_edge = min(first_edge) OVER (PARTITION BY map_id) AS is_start, last_edge = max(last_edge) OVER (PARTITION BY map_id) AS is_end FROM arcs")(lambda s, d: regions.canonical_arcs(region_map(s, d)[1]).select("map_id", "arc_id", "place", "is_start", "is_end"))
query("m11_canonical_chords", REG + "SELECT map_id, chord_id, row_number() OVER (PARTITION BY map_id ORDER BY lo, hi, y, chord_id) - 1 AS place FROM ch")(lambda s, d: regions.canonical_chords(region_map(s, d)[2]).select("map_id", "chord_id", "place"))
query("m12_chord_adjacent_arcs", REG + ", near AS (SELECT DISTINCT ch.map_id, chord_id, arc_id FROM ch JOIN arcs ON arcs.map_id = ch.map_id AND region_id IN (region_a, region_b) AND (ch.lo BETWEEN first_edge - 1 AND last_edge + 1 OR ch.hi BETWEEN first_edge - 1 AND last_edge + 1)) SELECT map_id, chord_id, string_agg(arc_id, ',' ORDER BY arc_id) AS arcs FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY map_id, chord_id ORDER BY arc_id) <= 4) GROUP BY 1, 2")(
    lambda s, d: regions.chord_adjacent_arcs((m := region_map(s, d))[2], m[1]).withColumn("arcs", F.concat_ws(",", F.col("arcs").cast("array<string>")))
)
query("m13_merge_chord_sets", REG + "SELECT map_id, lo, hi, y, bool_or(is_null_length) AS is_null_length FROM ch WHERE left_edge <> right_edge OR is_null_length GROUP BY 1, 2, 3, 4")(lambda s, d: regions.merge_chord_sets((c := region_map(s, d)[2]), c.withColumns({"left_edge": F.col("right_edge"), "right_edge": F.col("left_edge")}), c.where("chord_id % 2 = 0")))
query("m14_region_adjacency", REG + """, at_ AS (SELECT DISTINCT map_id, unnest([left_edge, left_edge - 1, right_edge, right_edge - 1]) AS e FROM chords), h AS (SELECT DISTINCT arcs.map_id, e, region_id FROM at_ JOIN arcs ON arcs.map_id = at_.map_id AND first_edge <= e AND e <= last_edge)
SELECT map_id, region_a AS r1, region_b AS r2 FROM chords UNION SELECT x.map_id, x.region_id, y.region_id FROM h x JOIN h y ON x.map_id = y.map_id AND x.e = y.e AND x.region_id < y.region_id""")(lambda s, d: regions.region_adjacency((m := region_map(s, d))[2], m[1]))
query("m15_split_regions", REG + "SELECT arcs.map_id, arcs.arc_id, (SELECT chord_id FROM ch WHERE ch.map_id = arcs.map_id AND ch.lo <= arcs.first_edge AND arcs.last_edge <= ch.hi ORDER BY ch.hi - ch.lo, chord_id LIMIT 1) AS chord_id FROM arcs")(lambda s, d: regions.split_regions((m := region_map(s, d))[1], m[2]))
query("m16_internal_chords", REG + ", b AS (SELECT DISTINCT ch.map_id, x.region_id, chord_id, lo FROM ch JOIN arcs x ON x.map_id = ch.map_id AND lo BETWEEN x.first_edge AND x.last_edge JOIN arcs y ON y.map_id = ch.map_id AND y.region_id = x.region_id AND hi BETWEEN y.first_edge AND y.last_edge) SELECT map_id, region_id, chord_id FROM b QUALIFY row_number() OVER (PARTITION BY map_id, region_id, lo ORDER BY chord_id) = 1")(lambda s, d: regions.internal_chords((m := region_map(s, d))[1], m[2]))
query("m17_region_boundary", REG + ", b AS (SELECT map_id, region_id, first_edge AS key, 1 AS kind, arc_id AS id FROM arcs UNION ALL SELECT map_id, region_a, lo, 0, chord_id FROM ch UNION ALL SELECT map_id, region_b, lo, 0, chord_id FROM ch) SELECT map_id, region_id, kind, id, row_number() OVER (PARTITION BY map_id, region_id ORDER BY key, kind, id) - 1 AS place FROM b")(lambda s, d: regions.region_boundary((m := region_map(s, d))[1], m[2]).select("map_id", "region_id", "kind", "id", "place"))

# Graphs

query("s3_read_graph", GRID + "SELECT gid, u, v FROM ge")(lambda s, d: tables.read_graph(*grid(s, d))[1])
query("s3_read_graph_costs", GRID + "SELECT gid, v, CAST(1 AS DOUBLE) AS cost FROM gv")(lambda s, d: tables.read_graph((g := grid(s, d))[0].drop("cost"), g[1])[0])
query("g1_undirected_edges", GRID + "SELECT gid, u, v FROM ge")(lambda s, d: graphs.undirected_edges(graphs.both_ways(e := grid(s, d)[1]).unionByName(e.select("gid", "u", F.col("u").alias("v")))))
query("g2_degree", GRID + "SELECT gid, v, count(*) AS degree FROM (SELECT gid, u AS v FROM ge UNION ALL SELECT gid, v FROM ge) GROUP BY 1, 2")(lambda s, d: graphs.degree(grid(s, d)[1]))


def _half(e: DataFrame) -> DataFrame:
    """Half-edges of a grid; pos: up, right, down, left."""
    side = F.when(F.col("head") == F.col("tail") - WIDTH, 0).when(F.col("head") == F.col("tail") + 1, 1).when(F.col("head") == F.col("tail") + WIDTH, 2).otherwise(3)
    return graphs.both_ways(e).select("gid", F.col("u").alias("tail"), F.col("v").alias("head")).withColumn("pos", side)


_H = f", h AS (SELECT gid, u AS tail, v AS head FROM ge UNION ALL SELECT gid, v, u FROM ge), p AS (SELECT *, CASE WHEN head = tail - {WIDTH} THEN 0 WHEN head = tail + 1 THEN 1 WHEN head = tail + {WIDTH} THEN 2 ELSE 3 END AS pos FROM h) "
query("g3_rotation", GRID + _H + "SELECT a.gid, a.tail, a.head, arg_min(b.head, (b.pos - a.pos + 3) % 4) AS cw, arg_min(b.head, (a.pos - b.pos + 3) % 4) AS ccw FROM p a JOIN p b ON a.gid = b.gid AND a.tail = b.tail GROUP BY 1, 2, 3")(lambda s, d: graphs.rotation(_half(grid(s, d)[1])).select("gid", "tail", "head", "cw", "ccw"))
query("g4_faces", GRID + "SELECT gid, (SELECT count(*) FROM ge e WHERE e.gid = x.gid) - count(*) + 1 + 1 AS faces, 2 * (SELECT count(*) FROM ge e WHERE e.gid = x.gid) AS sides FROM gv x WHERE EXISTS (SELECT 1 FROM ge e WHERE e.gid = x.gid) GROUP BY gid")(lambda s, d: graphs.embedded_faces(_half(grid(s, d)[1])).groupBy("gid").agg(F.count_distinct("face").alias("faces"), F.count("*").alias("sides")))
_SQUARE = "SELECT a.gid, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM gv a JOIN gv b ON b.gid = a.gid AND b.v = a.v + {w} JOIN gv c ON c.gid = a.gid AND c.v = b.v + 1 JOIN gv d ON d.gid = a.gid AND d.v = a.v + 1 WHERE a.v % {w} < {w} - 1".format(w=WIDTH)
query("g4_square_walks", GRID + f"SELECT gid, tail, head, a AS start_tail, b AS start_head, CAST(pos AS BIGINT) AS pos FROM (SELECT gid, a, b, unnest([a, b, c, d]) AS tail, unnest([b, c, d, a]) AS head, unnest([0, 1, 2, 3]) AS pos FROM ({_SQUARE}))")(
    lambda s, d: graphs.embedded_faces(_half(grid(s, d)[1])).where("size = 4").select("gid", "tail", "head", F.col("face.tail").alias("start_tail"), F.col("face.head").alias("start_head"), F.col("pos").cast("long").alias("pos"))
)
query("t7_fan_faces", GRID + f"SELECT a.gid, 2 * count(*) AS triangles FROM gv a JOIN gv b ON a.gid = b.gid AND b.v = a.v + {WIDTH + 1} AND a.v % {WIDTH} < {WIDTH - 1} GROUP BY 1")(
    lambda s, d: triangulation.fan_faces(graphs.embedded_faces(_half(grid(s, d)[1])).where("size = 4").select("gid", "face", "pos", F.col("tail").alias("v"))).groupBy("gid").agg(F.count("*").alias("triangles"))
)
query("g5_live_subgraph", GRID + "SELECT gid, u, v FROM ge WHERE u % 3 <> 0 AND v % 3 <> 0")(lambda s, d: graphs.live_subgraph(*(g := grid(s, d)), g[0].where("v % 3 <> 0"))[1])
_CYC = "WITH " + skyline_sql("l_suppkey")


def _cycles(s, d):
    e = rings.ring_edges(skylines(s, d, "l_suppkey"))
    place = lambda c: F.col("pid") * 100000 + F.col(c)
    v = e.select(F.col("pid") % 7, place("a").alias("v")).toDF("gid", "v").withColumn("cost", F.lit(1.0))
    return v, e.select((F.col("pid") % 7).alias("gid"), place("a").alias("u"), place("b").alias("v"))


query("g6_components", _CYC + "SELECT pid % 7 AS gid, pid * 100000 + idx AS v, pid * 100000 AS component FROM v")(lambda s, d: graphs.components(*_cycles(s, d)))
query("g7_component_cost", _CYC + "SELECT pid % 7 AS gid, pid * 100000 AS component, CAST(count(*) AS DOUBLE) AS cost, count(*) AS n FROM v GROUP BY pid")(lambda s, d: graphs.component_cost((g := _cycles(s, d))[0], graphs.components(*g)))
query("g7_heaviest", _CYC + ", c AS (SELECT pid % 7 AS gid, pid * 100000 AS component, CAST(count(*) AS DOUBLE) AS cost FROM v GROUP BY pid) SELECT gid, component, cost FROM c QUALIFY row_number() OVER (PARTITION BY gid ORDER BY cost DESC, component) = 1")(lambda s, d: graphs.heaviest(graphs.component_cost((g := _cycles(s, d))[0], graphs.components(*g))))
query("g13_pack_components", _CYC + ", c AS (SELECT pid % 7 AS gid, pid * 100000 AS component, CAST(count(*) AS DOUBLE) AS cost FROM v GROUP BY pid) SELECT gid, component, cost, CASE WHEN 3 * (sum(cost) OVER (PARTITION BY gid ORDER BY cost DESC, component) - cost) <= sum(cost) OVER (PARTITION BY gid) THEN 'A' ELSE 'B' END AS part FROM c")(lambda s, d: graphs.pack_components(graphs.component_cost((g := _cycles(s, d))[0], graphs.components(*g))).select("gid", "component", "cost", "part"))
query("g8_normalize_cost", GRID + "SELECT gid, v, cost / sum(cost) OVER (PARTITION BY gid) AS cost FROM gv")(lambda s, d: graphs.normalize_cost(grid(s, d)[0]))
_BFS = ", root AS (SELECT gid, min(v) AS v FROM gv GROUP BY gid), walk(gid, v, lvl) AS (SELECT gid, v, 0 FROM root UNION SELECT w.gid, h.head, w.lvl + 1 FROM walk w JOIN h ON h.gid = w.gid AND h.tail = w.v WHERE w.lvl < 30), h AS (SELECT gid, u AS tail, v AS head FROM ge UNION ALL SELECT gid, v, u FROM ge), lev AS (SELECT gid, v, min(lvl) AS level FROM walk GROUP BY 1, 2) "
_BFS = _BFS.replace(", h AS (SELECT gid, u AS tail, v AS head FROM ge UNION ALL SELECT gid, v, u FROM ge), lev", ", lev").replace(", root AS", ", h AS (SELECT gid, u AS tail, v AS head FROM ge UNION ALL SELECT gid, v, u FROM ge), root AS")
query("g9_bfs", GRID + _BFS + "SELECT a.gid, a.v, a.level, min(b.v) AS parent FROM lev a LEFT JOIN h ON h.gid = a.gid AND h.head = a.v LEFT JOIN lev b ON b.gid = a.gid AND b.v = h.tail AND b.level = a.level - 1 GROUP BY 1, 2, 3")(lambda s, d: graphs.bfs(*grid(s, d)))
_PROF = ", prof AS (SELECT gid, level, sum(cost) AS cost, count(*) AS size FROM lev JOIN gv USING (gid, v) GROUP BY 1, 2), prof2 AS (SELECT *, sum(cost) OVER w AS cost_to, sum(size) OVER w AS size_to FROM prof WINDOW w AS (PARTITION BY gid ORDER BY level)) "
query("g10_level_profile", GRID + _BFS + _PROF + "SELECT gid, level, cost, size, cost_to, CAST(size_to AS BIGINT) AS size_to FROM prof2")(lambda s, d: graphs.level_profile((g := grid(s, d))[0], graphs.bfs(*g)))
_CHO = """, t AS (SELECT gid, sum(cost) AS al, sum(size) AS n, max(level) AS last FROM prof GROUP BY 1), o AS (SELECT gid, min(level) AS l1, arg_min(size_to, level) AS k, any_value(n) AS n, any_value(last) AS last FROM prof2 JOIN t USING (gid) WHERE cost_to * 2 > al GROUP BY 1),
cho AS (SELECT gid, l1, (SELECT max(level) FROM prof p WHERE p.gid = o.gid AND level <= l1 AND size + 2 * (l1 - level) <= 2 * sqrt(k)) AS l0, coalesce((SELECT min(level) FROM prof p WHERE p.gid = o.gid AND level > l1 AND size + 2 * (level - l1 - 1) <= 2 * sqrt(n - k)), last + 1) AS l2, CAST(k AS BIGINT) AS k FROM o) """
query("g11_choose_levels", GRID + _BFS + _PROF + _CHO + "SELECT * FROM cho")(lambda s, d: graphs.choose_levels(graphs.level_profile((g := grid(s, d))[0], graphs.bfs(*g))))
query("g12_level_separator", GRID + _BFS + _PROF + _CHO + "SELECT lev.gid, v FROM lev JOIN cho ON cho.gid = lev.gid AND level IN (l0, l2)")(lambda s, d: graphs.level_separator(b := graphs.bfs(*(g := grid(s, d))), graphs.choose_levels(graphs.level_profile(g[0], b))))
_TREE = ", par AS (SELECT a.gid, a.v, a.level, min(b.v) AS parent FROM lev a LEFT JOIN h ON h.gid = a.gid AND h.head = a.v LEFT JOIN lev b ON b.gid = a.gid AND b.v = h.tail AND b.level = a.level - 1 GROUP BY 1, 2, 3), up(gid, v, x) AS (SELECT gid, v, v FROM par UNION ALL SELECT up.gid, up.v, par.parent FROM up JOIN par ON par.gid = up.gid AND par.v = up.x WHERE par.parent IS NOT NULL) "
query("g14_subtree_cost", GRID + _BFS + _TREE + "SELECT up.gid, up.x AS v, sum(gv.cost) AS subtree FROM up JOIN gv ON gv.gid = up.gid AND gv.v = up.v GROUP BY 1, 2")(lambda s, d: graphs.subtree_cost((g := grid(s, d))[0], graphs.bfs(*g)).select("gid", "v", "subtree"))


def _ends(v: DataFrame) -> DataFrame:
    return v.groupBy("gid").agg(F.max("v").alias("u"), (F.min("v") + 5).alias("v")).where("v <= u").select("gid", F.lit(1).alias("pair"), "u", "v")


_PATH = ", en AS (SELECT gid, max(v) AS u, min(v) + 5 AS w FROM gv GROUP BY gid HAVING min(v) + 5 <= max(v)), ua AS (SELECT up.gid, x FROM up JOIN en ON en.gid = up.gid AND up.v = en.u), wa AS (SELECT up.gid, x FROM up JOIN en ON en.gid = up.gid AND up.v = en.w), com AS (SELECT ua.gid, arg_max(ua.x, par.level) AS x, max(par.level) AS level FROM ua JOIN wa ON ua.gid = wa.gid AND ua.x = wa.x JOIN par ON par.gid = ua.gid AND par.v = ua.x GROUP BY 1), pth AS (SELECT t.gid, t.x AS vertex FROM (SELECT * FROM ua UNION SELECT * FROM wa) t JOIN par ON par.gid = t.gid AND par.v = t.x JOIN com ON com.gid = t.gid AND par.level >= com.level) "
query("g15_tree_path", GRID + _BFS + _TREE + _PATH + "SELECT gid, 1 AS pair, vertex FROM pth")(lambda s, d: graphs.tree_path(_ends((g := grid(s, d))[0]), graphs.bfs(*g)))


@query("g16_cycle_side_cost", GRID + _BFS + _TREE + _PATH + ", sub AS (SELECT up.gid, up.x AS v, sum(gv.cost) AS s FROM up JOIN gv ON gv.gid = up.gid AND gv.v = up.v GROUP BY 1, 2) SELECT pth.gid, 1 AS pair, pth.vertex, any_value(sub.s) - any_value(gv.cost) - coalesce(sum(ks.s), 0) AS hanging FROM pth JOIN sub ON sub.gid = pth.gid AND sub.v = pth.vertex JOIN gv ON gv.gid = pth.gid AND gv.v = pth.vertex LEFT JOIN (SELECT par.gid, par.parent, sub.s FROM par JOIN pth ON pth.gid = par.gid AND pth.vertex = par.v JOIN sub ON sub.gid = par.gid AND sub.v = par.v) ks ON ks.gid = pth.gid AND ks.parent = pth.vertex GROUP BY 1, 2, 3")
def _g16(s, d):
    v, e = grid(s, d)
    tree = graphs.bfs(v, e)
    return graphs.cycle_side_cost(cut(graphs.tree_path(_ends(v), tree)), tree, graphs.subtree_cost(v, tree), v)


query("g17_shrink", GRID + ", m AS (SELECT gid, v, CASE WHEN v % 100 < 40 THEN min(v) OVER (PARTITION BY gid, v % 100 < 40) ELSE v END AS t FROM gv) SELECT DISTINCT ge.gid, least(a.t, b.t) AS u, greatest(a.t, b.t) AS v FROM ge JOIN m a ON a.gid = ge.gid AND a.v = ge.u JOIN m b ON b.gid = ge.gid AND b.v = ge.v WHERE a.t <> b.t")(lambda s, d: graphs.shrink(*(g := grid(s, d)), g[0].where("v % 100 < 40").select("gid", "v"))[1])
_CYCLES = f""", nt AS (SELECT ge.* FROM ge JOIN par a ON a.gid = ge.gid AND a.v = ge.u JOIN par b ON b.gid = ge.gid AND b.v = ge.v WHERE a.parent IS DISTINCT FROM ge.v AND b.parent IS DISTINCT FROM ge.u),
legs AS (SELECT nt.gid, nt.u, nt.v, up.x, count(*) AS times FROM nt JOIN up ON up.gid = nt.gid AND up.v IN (nt.u, nt.v) GROUP BY 1, 2, 3, 4),
tops AS (SELECT l.gid, l.u, l.v, arg_max(l.x, par.level) AS x FROM legs l JOIN par ON par.gid = l.gid AND par.v = l.x WHERE times = 2 GROUP BY 1, 2, 3),
cyc AS (SELECT gid, u, v, x FROM legs WHERE times = 1 UNION ALL SELECT gid, u, v, x FROM tops),
walls AS (SELECT l.gid, l.u, l.v, least(l.x, par.parent) AS x FROM legs l JOIN par ON par.gid = l.gid AND par.v = l.x WHERE times = 1 AND abs(l.x - par.parent) = {WIDTH} UNION ALL SELECT gid, u, v, u FROM nt WHERE v - u = {WIDTH}),
free AS (SELECT nt.gid, nt.u, nt.v, gv.v AS x, gv.cost FROM nt JOIN gv ON gv.gid = nt.gid ANTI JOIN cyc ON cyc.gid = nt.gid AND cyc.u = nt.u AND cyc.v = nt.v AND cyc.x = gv.v),
held AS (SELECT f.gid, f.u, f.v, f.x, any_value(f.cost) AS cost, count(w.x) % 2 AS odd FROM free f LEFT JOIN walls w ON w.gid = f.gid AND w.u = f.u AND w.v = f.v AND w.x // {WIDTH} = f.x // {WIDTH} AND w.x < f.x GROUP BY 1, 2, 3, 4),
two AS (SELECT nt.gid, nt.u, nt.v, coalesce(sum(cost) FILTER (odd = 1), 0) AS a, coalesce(sum(cost) FILTER (odd = 0), 0) AS b FROM nt LEFT JOIN held USING (gid, u, v) GROUP BY 1, 2, 3) """
query("g18_best_cycle", GRID + _BFS + _TREE + _CYCLES + "SELECT gid, u, v, least(a, b) AS smaller, greatest(a, b) AS larger FROM two QUALIFY row_number() OVER (PARTITION BY gid ORDER BY greatest(a, b), u, v) = 1")(
    lambda s, d: graphs.best_cycle((g := grid(s, d))[0], _half(g[1]), graphs.bfs(*g)).select("gid", "u", "v", F.least("inside", "outside").alias("smaller"), "larger")
)
query("g19_sides", GRID + f", c AS (SELECT gid, v FROM gv WHERE v % {WIDTH} = 9), w AS (SELECT gid, v % {WIDTH} < 9 AS west, sum(cost) AS s, min(v) AS low FROM gv WHERE v % {WIDTH} <> 9 GROUP BY 1, 2), p AS (SELECT gid, west, CASE WHEN 3 * (sum(s) OVER (PARTITION BY gid ORDER BY s DESC, low) - s) <= sum(s) OVER (PARTITION BY gid) THEN 'A' ELSE 'B' END AS part FROM w) SELECT gv.gid, v, CASE WHEN v % {WIDTH} = 9 THEN 'C' ELSE part END AS part FROM gv LEFT JOIN p ON p.gid = gv.gid AND p.west = (v % {WIDTH} < 9)")(lambda s, d: graphs.sides(*(g := grid(s, d)), g[0].where(f"v % {WIDTH} = 9").select("gid", "v")))
_OK = GRID + "SELECT DISTINCT gid, TRUE AS a_ok, TRUE AS b_ok, TRUE AS c_ok, CAST(0 AS BIGINT) AS crossing, CAST(0 AS BIGINT) AS misplaced FROM gv"


@query("g20_find_separator", GRID + "SELECT gid, TRUE AS a_ok, TRUE AS b_ok, TRUE AS c_ok, CAST(0 AS BIGINT) AS crossing, CAST(0 AS BIGINT) AS misplaced FROM gv GROUP BY gid")
def _g20(s, d):
    v, e = grid(s, d)
    return _flags(cut(graphs.find_separator(v, e)), v, e)


def _flags(parts: DataFrame, v: DataFrame, e: DataFrame) -> DataFrame:
    """Balance and size of separators, edges across and vertices out of place."""
    flags = quality.check_balance(parts, v)
    for name, bad in (("crossing", quality.check_cross_edges(parts, e)), ("misplaced", quality.check_partition(parts, v))):
        flags = flags.join(bad.groupBy("gid").agg(F.count("*").alias(name)), "gid", "left").na.fill(0, [name])
    return flags


_STACKED = f"SELECT CAST(p_partkey // {STACK} AS BIGINT) AS gid, CAST(p_partkey AS BIGINT) AS v, CAST(p_size AS DOUBLE) AS cost FROM part"


@query("g20_find_separator_stacked", f"SELECT gid, TRUE AS a_ok, TRUE AS b_ok, TRUE AS c_ok, CAST(0 AS BIGINT) AS crossing, CAST(0 AS BIGINT) AS misplaced, greatest(2 * count(*) - 4, 2) AS triangles FROM ({_STACKED}) GROUP BY gid HAVING count(*) >= 3")
def _g20_stacked(s, d):
    """Separators of stacked triangulations, which need a cycle between the levels; and the number of their faces of three sides."""
    v, e, half = map(cut, stacked(s, d))
    three = darts.dart_faces(darts.around(darts.darts_of(half))).where("size = 3 and pos = 0").groupBy("gid").agg(F.count("*").alias("triangles"))
    return _flags(cut(graphs.find_separator(v, e, half=half)), v, e).join(three, "gid")


@query("g21_iterated_separator_stacked", f"SELECT gid, TRUE AS size_ok, TRUE AS all_ok, TRUE AS ids_ok FROM ({_STACKED}) GROUP BY gid")
def _g21_stacked(s, d):
    v, e, half = map(cut, stacked(s, d))
    return quality.check_pieces(cut(graphs.iterated_separator(v, e, 60, half=half)), v, 60)


@query("g17_shrink_embedded", GRID + f", m AS (SELECT gid, v, CASE WHEN v % {BLOCK} < 40 THEN min(v) OVER (PARTITION BY gid, v % {BLOCK} < 40) ELSE v END AS t FROM gv), s AS (SELECT DISTINCT ge.gid, least(a.t, b.t) AS u, greatest(a.t, b.t) AS v FROM ge JOIN m a ON a.gid = ge.gid AND a.v = ge.u JOIN m b ON b.gid = ge.gid AND b.v = ge.v WHERE a.t <> b.t), r AS (SELECT s.gid, u AS tail, s.v AS head, row_number() OVER (PARTITION BY s.gid ORDER BY s.v DESC) AS place, count(*) OVER (PARTITION BY s.gid) AS n, min(s.v) OVER (PARTITION BY s.gid) AS low FROM s WHERE u % {BLOCK} = 0) SELECT gid, tail, head, place % n AS place FROM r")
def _g17_embedded(s, d):
    """The rotation of the vertex that the upper two rows of each grid become, counted from its lowest neighbour: the vertices of the third row, from right to left."""
    v, e = grid(s, d)
    inside = v.where(f"v % {BLOCK} < 40").select("gid", "v")
    tree = graphs.bfs(*graphs.live_subgraph(v, e, inside)).select("gid", "v", "parent")
    _, new = darts.shrink_embedded(v, darts.darts_of(_half(e)), inside, tree)
    ring = darts.around(new).where(f"tail % {BLOCK} = 0")
    zero = ring.groupBy("gid").agg(F.min_by("p", "head").alias("zero"), F.count("*").alias("n"))
    return ring.join(zero, "gid").select("gid", "tail", "head", F.pmod(F.col("p") - F.col("zero"), F.col("n")).alias("place"))


@query("g21_iterated_separator", GRID + "SELECT gid, TRUE AS size_ok, TRUE AS all_ok, TRUE AS ids_ok FROM gv GROUP BY gid")
def _g21(s, d):
    v, e = grid(s, d)
    return quality.check_pieces(cut(graphs.iterated_separator(v, e, 30)), v, 30)


_COL = f"CASE WHEN v % {WIDTH} = 9 THEN 'C' WHEN v % {WIDTH} < 9 THEN 'A' ELSE 'B' END"
_parts = lambda v: v.select("gid", "v", F.expr(_COL).alias("part"))
query("q5_check_partition", GRID + "SELECT gid, v, CASE WHEN v % 10 = 0 THEN 2 ELSE 0 END AS times FROM gv WHERE v % 10 IN (0, 1)")(lambda s, d: quality.check_partition((p := _parts(v := grid(s, d)[0])).unionByName(p.where("v % 10 = 0")).where("v % 10 <> 1"), v))
query("q6_check_balance", GRID + f", p AS (SELECT *, {_COL} AS part FROM gv) SELECT gid, coalesce(sum(cost) FILTER (part = 'A'), 0) * 3 <= sum(cost) * 2 + 1e-9 AS a_ok, coalesce(sum(cost) FILTER (part = 'B'), 0) * 3 <= sum(cost) * 2 + 1e-9 AS b_ok, count(*) FILTER (part = 'C') <= 2 * sqrt(2) * sqrt(count(*)) AS c_ok FROM p GROUP BY gid")(lambda s, d: quality.check_balance(_parts(v := grid(s, d)[0]), v))
query("q7_check_cross_edges", GRID + f"SELECT gid, u, v FROM ge WHERE u % {WIDTH} = 8 AND v % {WIDTH} = 9")(lambda s, d: quality.check_cross_edges((g := grid(s, d))[0].select("gid", "v", F.expr(f"CASE WHEN v % {WIDTH} < 9 THEN 'A' ELSE 'B' END").alias("part")), g[1]))
query("q8_check_pieces", GRID + f"SELECT gid, max(n) <= 45 AS size_ok, TRUE AS all_ok, TRUE AS ids_ok FROM (SELECT gid, v % {WIDTH} < 9 AS w, count(*) FILTER (v % {WIDTH} <> 9) AS n FROM gv WHERE v % {WIDTH} <> 9 GROUP BY 1, 2) GROUP BY gid")(
    lambda s, d: quality.check_pieces((v := grid(s, d)[0]).select("gid", "v", (F.col("v") % WIDTH == 9).alias("is_separator"), F.when(F.col("v") % WIDTH != 9, (F.col("v") % WIDTH > 9).cast("long")).alias("piece_id")), v, 45)
)



@query("m18_center_tree", REG + "SELECT map_id AS gid, count(*) - 1 AS splits, TRUE AS balanced FROM regions GROUP BY 1 HAVING count(*) > 1")
def _m18(s, d):
    """Splits of each map's region tree, and whether no side ever held over three quarters (two thirds for three regions)."""
    r, _, c = region_map(s, d)
    tree = r.join(c.select("map_id", F.col("region_b").alias("region_id"), F.col("region_a").alias("parent")), ["map_id", "region_id"], "left").select(F.col("map_id").alias("gid"), F.col("region_id").alias("v"), "parent")
    return regions.center_tree(tree).groupBy("gid").agg(F.count("*").alias("splits"), F.bool_and(F.col("larger") * 4 <= F.col("size") * 3).alias("balanced"))
