"""Registered queries of the region tables of real visibility maps, of nested chords, and of the ways for giant keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import darts, graphs, maps, regions, rings, triangulation, visibility
from .plans.fixtures import NESTED_SQL, WIDTH, grid, nested_map, region_map, skyline_sql, skylines
from .plans.iterate import cut
from .queries import _DIAG, _SHOT, _TRAPS, ORACLES, _pieces, query
from .queries_graphs import _H, _SQUARE, GRID, REG, _half

# Visibility maps of the skylines by part: the same names as the made-up maps have in their SQL

VIS = (
    "WITH "
    + skyline_sql()
    + _TRAPS
    + """,
tr AS (SELECT t.pid AS map_id, top_v * 2 + CASE WHEN left_edge = top_v THEN 1 ELSE 0 END AS region_id, top_v, bottom_v, left_edge, right_edge, a.y AS top_y, b.y AS bottom_y
  FROM traps t JOIN v a ON a.pid = t.pid AND a.idx = top_v JOIN v b ON b.pid = t.pid AND b.idx = bottom_v),
regions AS (SELECT map_id, region_id FROM tr),
arcs AS (SELECT map_id, region_id * 2 AS arc_id, region_id, left_edge AS first_edge, left_edge AS last_edge, 'L' AS first_side, CAST(top_y > bottom_y AS BIGINT) AS edge_count, top_y AS y_first, bottom_y AS y_last FROM tr
  UNION ALL SELECT map_id, region_id * 2 + 1, region_id, right_edge, right_edge, 'R', CAST(top_y > bottom_y AS BIGINT), bottom_y, top_y FROM tr),
chords AS (SELECT a.map_id, a.bottom_v * 2 + CASE WHEN a.left_edge = b.left_edge THEN 0 ELSE 1 END AS chord_id, a.region_id AS region_a, b.region_id AS region_b,
    CASE WHEN a.left_edge = b.left_edge THEN a.left_edge ELSE a.bottom_v END AS left_edge, CASE WHEN a.left_edge = b.left_edge THEN a.bottom_v ELSE a.right_edge END AS right_edge, a.bottom_y AS y, FALSE AS is_null_length
  FROM tr a JOIN tr b ON a.map_id = b.map_id AND a.bottom_v = b.top_v
  UNION ALL SELECT map_id, top_v * 2, region_id, region_id, top_v, top_v, top_y, TRUE FROM tr a WHERE NOT EXISTS (SELECT 1 FROM tr b WHERE b.map_id = a.map_id AND b.bottom_v = a.top_v)
  UNION ALL SELECT map_id, bottom_v * 2, region_id, region_id, bottom_v, bottom_v, bottom_y, TRUE FROM tr a WHERE NOT EXISTS (SELECT 1 FROM tr b WHERE b.map_id = a.map_id AND b.top_v = a.bottom_v)),
ch AS (SELECT *, least(left_edge, right_edge) AS lo, greatest(left_edge, right_edge) AS hi FROM chords)"""
)


def _map(s, d):
    return visibility.region_tables(skylines(s, d))


def _placed(s, d, rows, tables):
    """What rows gives for maps in place, and tables for the region tables of giant polygons."""
    few, many = maps.region_maps(cut(skylines(s, d)))
    return rows(few) if many is None else rows(few).unionByName(tables(*many))


query("r6_region_arcs", VIS + " SELECT map_id, arc_id, region_id, first_edge, first_side, edge_count, y_first, y_last FROM arcs")(
    lambda s, d: _map(s, d)[1].select("map_id", "arc_id", "region_id", "first_edge", "first_side", "edge_count", "y_first", "y_last")
)
query("r6_region_chords", VIS + " SELECT map_id, chord_id, region_a, region_b, left_edge, right_edge, y, is_null_length FROM chords")(lambda s, d: _map(s, d)[2])


@query("r6_region_counts", VIS + " SELECT map_id, count(*) AS regions, count(*) - 1 AS chords FROM regions GROUP BY 1")
def _counts(s, d):
    """Regions of each map, and chords of a length: a tree."""
    r, _, c = _map(s, d)
    chords = c.where("not is_null_length").groupBy("map_id").agg(F.count("*").alias("chords"))
    return r.groupBy("map_id").agg(F.count("*").alias("regions")).join(chords, "map_id", "left").na.fill(0, ["chords"])


def on_visible(name: str, run, sql=lambda x: x, rows=None) -> None:
    """A query of the made-up maps again, over the visibility maps; rows: its way for maps in place."""
    query(f"{name}_visible", sql(VIS + ORACLES[name].removeprefix(REG)))(lambda s, d: run(*_map(s, d)) if rows is None else _placed(s, d, rows, run))


def _joined_arcs(t):
    return t.withColumn("arcs", F.concat_ws(",", F.col("arcs").cast("array<string>")))


on_visible("m1_region_weight", lambda r, a, c: regions.region_weight(r, a))
on_visible("m2_region_degree", lambda r, a, c: regions.region_degree(r, c))
on_visible("m3_map_flags", lambda r, a, c: regions.map_flags(r, a, c, 9))
on_visible("m10_canonical_arcs", lambda r, a, c: regions.canonical_arcs(a).select("map_id", "arc_id", "place", "is_start", "is_end"))
on_visible("m12_chord_adjacent_arcs", lambda r, a, c: _joined_arcs(regions.chord_adjacent_arcs(c, a)), rows=lambda m: _joined_arcs(maps.chord_adjacent_arcs(m)))
on_visible("m14_region_adjacency", lambda r, a, c: regions.region_adjacency(c, a), lambda x: x.replace("SELECT map_id, region_a AS r1, region_b AS r2 FROM chords UNION", "SELECT map_id, least(region_a, region_b) AS r1, greatest(region_a, region_b) AS r2 FROM chords WHERE region_a <> region_b UNION"), maps.region_adjacency)
on_visible("m16_internal_chords", lambda r, a, c: regions.internal_chords(a, c), rows=maps.internal_chords)
on_visible("m17_region_boundary", lambda r, a, c: regions.region_boundary(a, c).select("map_id", "region_id", "kind", "id", "place"), lambda x: x.replace("SELECT map_id, region_b, lo, 0, chord_id FROM ch", "SELECT map_id, region_b, lo, 0, chord_id FROM ch WHERE region_a <> region_b"))

_AT = " FROM chords c {join} JOIN arcs ON arcs.map_id = c.map_id AND first_edge <= c.left_edge AND c.left_edge <= last_edge AND c.y BETWEEN least(y_first, y_last) AND greatest(y_first, y_last)"
query("m9_locate_on_arcs_at_height", VIS + " SELECT c.map_id, chord_id AS query_id, region_id, min(arc_id) AS arc_id" + _AT.format(join="") + " GROUP BY 1, 2, 3")(
    lambda s, d: _placed(s, d, lambda m: maps.locate_on_arcs(m, F.transform("c_", lambda x: F.struct(x["chord_id"].alias("query_id"), x["left_edge"].alias("e"), x["y"].alias("y")))), lambda r, a, c: regions.locate_on_arcs(c.select("map_id", F.col("chord_id").alias("query_id"), F.col("left_edge").alias("e"), "y"), a))
)
query("r10_region_locate_at_height", VIS + " SELECT c.map_id, chord_id AS query_id, min(region_id) AS region" + _AT.format(join="LEFT") + " AND first_side = 'L' GROUP BY 1, 2")(
    lambda s, d: visibility.region_locate_on_edge((m := _map(s, d))[2].select("map_id", F.col("chord_id").alias("query_id"), F.col("left_edge").alias("e"), "y", F.lit("L").alias("side")), m[1])
)


def _trees(r, a, c):
    """The region trees of the visibility maps, rooted at the lowest region by a walk over chords."""
    v = r.select(F.col("map_id").alias("gid"), F.col("region_id").alias("v"))
    e = c.where("not is_null_length").select(F.col("map_id").alias("gid"), F.col("region_a").alias("u"), F.col("region_b").alias("v"))
    return graphs.bfs(v, e).select("gid", "v", "parent")


def _tree_flags(r, a, c):
    """What maps.tree_flags gives, by joins."""
    tree = cut(_trees(*map(cut, (r, a, c))))
    splits = cut(regions.center_tree(tree))
    td = cut(regions.decomposition_tree(tree, splits))
    kids = td.where("parent is not null").groupBy("gid", F.col("parent").alias("node")).agg(F.count("*").alias("kids"), F.min("depth").alias("low"), F.max("depth").alias("high"))
    t = td.join(kids, ["gid", "node"], "left")
    good = F.when(F.col("region").isNull(), F.coalesce(F.col("kids") == 2, F.lit(False))).otherwise(F.col("kids").isNull())
    levels = F.coalesce((F.col("low") == F.col("depth") + 1) & (F.col("high") == F.col("depth") + 1), F.lit(True))
    flags = t.groupBy("gid").agg(F.count("region").alias("leaves"), F.count_if(F.col("region").isNull()).alias("splits"), F.bool_and(good).alias("good"), F.count_if(F.col("parent").isNull()).alias("roots"), F.bool_and(levels).alias("levels_ok"))
    even = splits.groupBy("gid").agg(F.bool_and(F.col("larger") * 4 <= F.col("size") * 3 + 1).alias("balanced"))
    return flags.join(even, "gid", "left").select("gid", "leaves", "splits", "good", "roots", "levels_ok", F.coalesce("balanced", F.lit(True)).alias("balanced"))


@query("m18_decomposition_tree", VIS + ", n AS (SELECT map_id, count(*) AS n FROM regions GROUP BY 1) SELECT map_id AS gid, n AS leaves, n - 1 AS splits, TRUE AS binary_tree, TRUE AS levels_ok, TRUE AS balanced FROM n")
def _td(s, d):
    """Leaves and inner nodes; whether there is one root and each inner node has two children a level deeper; whether no part ever held more than three quarters (and a quarter vertex) of what was split."""
    flags = _placed(s, d, lambda m: maps.tree_flags(maps.decomposition_tree(m)), _tree_flags)
    return flags.select("gid", "leaves", "splits", (F.col("good") & (F.col("roots") == 1)).alias("binary_tree"), "levels_ok", "balanced")


# Nested chords put in

NEST = "WITH " + NESTED_SQL


def _put(s, d, which):
    return regions.put_chords(*map(cut, nested_map(s, d)))[which]


query("m15_put_chords_arcs", NEST + " SELECT map_id, j AS arc_id, region_id FROM held")(lambda s, d: _put(s, d, 1).select("map_id", "arc_id", "region_id"))
query("m15_put_chords", NEST + " SELECT map_id, j AS chord_id, region_id AS region_a, j + 1 AS region_b, j AS left_edge, j AS right_edge, CAST(q AS DOUBLE) AS y FROM held WHERE j % 6 = 1 UNION ALL SELECT map_id, chord_id, outer_, own, lo, hi, y FROM up")(
    lambda s, d: _put(s, d, 2).select("map_id", "chord_id", "region_a", "region_b", "left_edge", "right_edge", "y")
)
query("m15_put_chords_regions", NEST + " SELECT r.map_id, r.region_id, coalesce(max(q % 11), 0) AS weight FROM (SELECT map_id, own AS region_id FROM own UNION ALL SELECT map_id, j + 1 FROM a WHERE j % 6 = 1 UNION ALL SELECT DISTINCT map_id, 0 FROM a) r LEFT JOIN held ON held.map_id = r.map_id AND held.region_id = r.region_id GROUP BY 1, 2")(lambda s, d: _put(s, d, 0))

# Ranges with sides


@query(
    "m7_split_ranges_sides",
    REG + ", q AS (SELECT map_id, chord_id AS range_id, lo AS s, hi AS e, lo + chord_id % 7 AS turn FROM ch), e2 AS (SELECT q.map_id, range_id, first_edge AS fin FROM q JOIN arcs USING (map_id) WHERE s <= first_edge AND first_edge < e UNION SELECT map_id, range_id, e FROM q), "
    "p AS (SELECT e2.map_id, e2.range_id, coalesce(lag(fin) OVER (PARTITION BY e2.map_id, e2.range_id ORDER BY fin) + 1, s) AS s, fin AS e, turn FROM e2 JOIN q USING (map_id, range_id)) "
    "SELECT map_id, range_id, s, e, CASE WHEN s < turn THEN 'L' ELSE 'R' END AS first_side, CASE WHEN e < turn THEN 'L' ELSE 'R' END AS last_side FROM p",
)
def _m7_sides(s, d):
    _, a, c = region_map(s, d)
    lo, hi = F.least("left_edge", "right_edge"), F.greatest("left_edge", "right_edge")
    ranges = c.select("map_id", F.col("chord_id").alias("range_id"), lo.alias("s"), hi.alias("e"), F.lit("L").alias("first_side"), F.lit("R").alias("last_side"), (lo + F.col("chord_id") % 7).alias("turn"))
    return regions.split_ranges(ranges, a.select("map_id", F.col("first_edge").alias("edge")))


# The ways for giant keys give the same rows

query("v3_ring_neighbors_ranged", ORACLES["v3_ring_neighbors"])(lambda s, d: rings.ring_neighbors(skylines(s, d), ranged=True).select("pid", "idx", "prev_idx", "next_idx", "prev_y", "next_y", "n"))
query("v7_y_rank_ranged", ORACLES["v7_y_rank"])(lambda s, d: rings.y_rank(skylines(s, d), ranged=True).select("pid", "idx", "rk"))
query("r8_trapezoids_ranged", ORACLES["r8_trapezoids"])(lambda s, d: visibility.trapezoids(skylines(s, d), small=0, ranged=True))
query("m8_assign_arcs_ranged", ORACLES["m8_assign_arcs"])(
    lambda s, d: regions.assign_arcs((m := region_map(s, d))[1].select("map_id", "arc_id", F.col("first_edge").alias("key")), m[2].select("map_id", F.least("left_edge", "right_edge").alias("key")), ranged=True)
)
query("m10_canonical_arcs_ranged", ORACLES["m10_canonical_arcs"])(lambda s, d: regions.canonical_arcs(region_map(s, d)[1], ranged=True).select("map_id", "arc_id", "place", "is_start", "is_end"))
query("m11_canonical_chords_ranged", ORACLES["m11_canonical_chords"])(lambda s, d: regions.canonical_chords(region_map(s, d)[2], ranged=True).select("map_id", "chord_id", "place"))


@query("r9_locate_by_height_ranged", ORACLES["r9_locate_by_height"])
def _r9_ranged(s, d):
    v = cut(skylines(s, d))
    c = v.groupBy("pid", "y").agg(F.min("idx").alias("above")).select(F.col("pid").alias("map_id"), "y", "above", (F.col("above") + 1000).alias("below"))
    return visibility.locate_by_height(v.select(F.col("pid").alias("map_id"), F.col("idx").alias("query_id"), "y"), c, ranged=True)


# Counts of each polygon


@query(
    "s5_polygon_counts",
    "WITH " + skyline_sql("l_suppkey") + ", c AS (SELECT pid, count(*) AS n, CAST(ceil(log2(count(*) - 1)) AS BIGINT) AS p FROM v GROUP BY pid) "
    "SELECT pid, n AS vertices, (CAST(1 AS BIGINT) << p) + 1 AS padded, n AS edges, p + 1 AS grades, n - 1 AS regions, n - 2 AS chords, 2 * (n - 1) AS arcs, n - 2 AS triangles FROM c",
)
def _s5_counts(s, d):
    return triangulation.polygon_counts(cut(skylines(s, d, "l_suppkey")))


# Rays against chords and edges


@query(
    "r4_shoot_chords_and_edges",
    "WITH " + skyline_sql() + _SHOT + """,
rays AS (SELECT pid, idx * 2 AS ray_id, 'L' AS side, x, y, hl AS e, hl_x AS e_x FROM shot UNION ALL SELECT pid, idx * 2 + 1, 'R', x, y, hr, hr_x FROM shot),
ends AS (SELECT pid, idx, y, x + 0.25 AS x1, x + 0.75 AS x2 FROM v WHERE idx > 1),
hit AS (SELECT r.pid, ray_id, 'CHORD' AS hit_type, idx AS hit_id, CASE WHEN side = 'L' THEN x2 ELSE x1 END AS hit_x, CASE WHEN side = 'L' THEN x - x2 ELSE x1 - x END AS d FROM rays r JOIN ends c ON c.pid = r.pid AND c.y = r.y
  UNION ALL SELECT pid, ray_id, 'ARC', e, e_x, abs(e_x - x) FROM rays WHERE e IS NOT NULL),
best AS (SELECT * FROM hit WHERE d >= 0 QUALIFY row_number() OVER (PARTITION BY pid, ray_id ORDER BY d, hit_type = 'ARC', hit_id) = 1)
SELECT r.pid, r.ray_id, hit_type, hit_id, hit_x FROM rays r LEFT JOIN best b ON b.pid = r.pid AND b.ray_id = r.ray_id""",
)
def _r4_both(s, d):
    """From every vertex to both sides: chords behind every roof vertex at its height, in competition with the edges."""
    shot = cut(visibility.ray_shoot(skylines(s, d)))
    side = lambda k, name, e: F.struct((F.col("idx") * 2 + k).alias("ray_id"), F.lit(name).alias("side"), F.col(e).alias("e"), F.col(f"{e}_x").alias("hit_x"))
    rays = shot.select("pid", "idx", "x", "y", F.inline(F.array(side(0, "L", "hl"), side(1, "R", "hr"))))
    chords = shot.where("idx > 1").select("pid", F.col("idx").alias("chord_id"), "y", (F.col("x") + 0.25).alias("x1"), (F.col("x") + 0.75).alias("x2"))
    return visibility.shoot_chords(rays.select("pid", "ray_id", "x", "y", "side"), chords, rays.select("pid", "ray_id", "e", "hit_x"))


# Chords taken out of real maps, the first of them only


@query("m6_coarsen_first", VIS + " SELECT map_id, TRUE AS bounded, TRUE AS maximal, count(*) AS late FROM chords WHERE chord_id >= 20 GROUP BY 1")
def _m6_first(s, d):
    """Visibility maps without the chords below 20 that could go: weights within gamma, no such chord left, and every later chord still there."""
    gamma, first = 4, 20

    def rows(m):
        m = maps.coarsen(m, gamma, first)
        m = m.select("map_id", "a_", "c_", F.exists(maps.merged_weights(m), lambda x: (F.least(x["da"], x["db"]) < 3) & (x["merged"] <= gamma) & (x["chord_id"] < first)).alias("left_"))
        late = F.size(F.filter("c_", lambda x: x["chord_id"] >= first)).cast("long")
        return m.select("map_id", F.forall("a_", lambda x: x["edge_count"] <= gamma).alias("bounded"), (~F.col("left_")).alias("maximal"), late.alias("late")).where("late > 0")

    def tables(r, a, c):
        r, a, c = regions.coarsen(*map(cut, (r, a, c)), gamma, below=first)
        left = regions.merged_weights(r, a, c).where((F.least("da", "db") < 3) & (F.col("merged") <= gamma) & (F.col("chord_id") < first)).groupBy("map_id").agg(F.count("*").alias("left_"))
        late = c.where(F.col("chord_id") >= first).groupBy("map_id").agg(F.count("*").alias("late"))
        return regions.region_weight(r, a).groupBy("map_id").agg((F.max("weight") <= gamma).alias("bounded")).join(left, "map_id", "left").join(late, "map_id").select("map_id", "bounded", F.col("left_").isNull().alias("maximal"), "late")

    return _placed(s, d, rows, tables)


# Rotations from edges put in one by one; triangles of the fans


@query("g3_rotation_inserted", GRID + _H + "SELECT a.gid, a.tail, a.head, arg_min(b.head, (b.pos - a.pos + 3) % 4) AS cw FROM p a JOIN p b ON a.gid = b.gid AND a.tail = b.tail GROUP BY 1, 2, 3")
def _g3_inserted(s, d):
    """The grid, its edges put in by rows: an edge to the right behind the one up, an edge down behind that to the right, else that up; other ends come last."""
    v, e = grid(s, d)
    down = F.col("v") - F.col("u") == WIDTH
    e = cut(e.select("gid", (F.col("u") * 2 + down.cast("int")).alias("e"), "u", "v", down.alias("down")))
    there = lambda name, shift: e.select("gid", (F.col("e") + shift).alias("at"), F.col("e").alias(name))
    own = e.withColumn("at", F.col("u") * 2)
    own = own.join(there("up", 2 * WIDTH - 1).where("up % 2 = 1"), ["gid", "at"], "left").join(there("right", 0).where("right % 2 = 0"), ["gid", "at"], "left")
    after = F.when(F.col("down"), F.coalesce("right", "up")).otherwise(F.col("up"))
    turns = darts.around(darts.inserted(own.select("gid", "e", "u", "v", after.alias("after_u"), F.lit(None).cast("long").alias("after_v"))))
    return turns.join(turns.select("gid", F.col("d").alias("cw"), F.col("head").alias("then")), ["gid", "cw"]).select("gid", "tail", "head", F.col("then").alias("cw"))


query("t7_fan_triangles", GRID + f"SELECT gid, a, b, c FROM ({_SQUARE}) UNION ALL SELECT gid, a, c, d FROM ({_SQUARE})")(
    lambda s, d: triangulation.fan_faces(graphs.embedded_faces(_half(grid(s, d)[1])).where("size = 4").select("gid", "face", "pos", F.col("tail").alias("v"))).select("gid", "a", "b", "c")
)


# Pieces of the triangulation as rows; a piece is known by its lowest half-edge

_PIECES = (
    "WITH RECURSIVE "
    + skyline_sql()
    + _DIAG
    + """,
nb AS (SELECT pid, idx AS at_, (idx + 1) % n AS to_, 1 AS turn FROM v JOIN nn USING (pid) UNION ALL SELECT pid, (idx + 1) % n, idx, n - 1 FROM v JOIN nn USING (pid)
  UNION ALL SELECT pid, u, w, w - u FROM dg UNION ALL SELECT pid, w, u, n + u - w FROM dg JOIN nn USING (pid)),
nx AS (SELECT pid, to_ AS tail, at_ AS head, lag(to_) OVER (PARTITION BY pid, at_ ORDER BY turn) AS then_ FROM nb),
hn AS (SELECT * FROM nx WHERE then_ IS NOT NULL),
walk AS (SELECT pid, tail AS t0, head AS h0, tail, head, CAST(0 AS BIGINT) AS pos FROM hn
  UNION ALL SELECT w.pid, t0, h0, hn.head, hn.then_, pos + 1 FROM walk w JOIN hn ON hn.pid = w.pid AND hn.tail = w.tail AND hn.head = w.head WHERE NOT (hn.head = t0 AND hn.then_ = h0)),
low AS (SELECT pid, t0, h0, count(*) AS size FROM walk GROUP BY 1, 2, 3 HAVING bool_and(tail > t0 OR (tail = t0 AND head >= h0))),
pc AS (SELECT walk.pid, t0, h0, pos, tail AS idx, size FROM walk JOIN low USING (pid, t0, h0))"""
)
query("t2_piece_rows", _PIECES + " SELECT pid, t0 AS piece_tail, h0 AS piece_head, pos, idx FROM pc")(
    lambda s, d: _pieces(s, d).select("pid", F.col("piece.tail").alias("piece_tail"), F.col("piece.head").alias("piece_head"), "pos", "idx")
)
query(
    "t3_mountain_rows",
    _PIECES
    + """, m AS (SELECT pc.pid, t0, h0, any_value(size) AS size, arg_max(pc.idx, rk) AS top, arg_min(pc.idx, rk) AS bottom, arg_max(pos, rk) AS tp, arg_min(pos, rk) AS bp FROM pc JOIN r ON r.pid = pc.pid AND r.idx = pc.idx GROUP BY 1, 2, 3)
SELECT pid, t0 AS piece_tail, h0 AS piece_head, size, top, bottom, CASE WHEN (tp - bp + size) % size = 1 THEN tp WHEN (bp - tp + size) % size = 1 THEN bp END AS start_pos, CASE WHEN (tp - bp + size) % size = 1 THEN 'down' WHEN (bp - tp + size) % size = 1 THEN 'up' END AS direction FROM m""",
)(lambda s, d: triangulation.mountain_base(_pieces(s, d)).select("pid", F.col("piece.tail").alias("piece_tail"), F.col("piece.head").alias("piece_head"), "size", "top", "bottom", "start_pos", "direction"))


# Chords taken out of real maps: the joined regions branch

_LOW = """, dr AS (SELECT map_id, region_a AS x, region_b AS y FROM chords WHERE chord_id % 4 = 0 UNION SELECT map_id, region_b, region_a FROM chords WHERE chord_id % 4 = 0),
cl AS (SELECT map_id, region_id, region_id AS other FROM regions UNION SELECT cl.map_id, cl.region_id, dr.y FROM cl JOIN dr ON dr.map_id = cl.map_id AND dr.x = cl.other),
low AS (SELECT map_id, region_id, min(other) AS low FROM cl GROUP BY 1, 2),
used AS"""


def _branching(sql: str) -> str:
    head, rest = sql.split(", low AS", 1)
    rest = rest.split("used AS", 1)[1].replace("chord_id % 2 = 1", "chord_id % 4 <> 0").replace("chord_id % 2 = 0", "chord_id % 4 = 0")
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + _LOW + rest


@query("m5_contract_chords_visible", _branching(VIS + ORACLES["m5_contract_chords"].removeprefix(REG)))
def _m5_visible(s, d):
    """Arcs of visibility maps after the chords of every second vertex's left side have gone, with their regions' weights."""
    def rows(m):
        glued = maps.contract_chords(m, lambda x: x["chord_id"] % 4 == 0).select("map_id", F.inline("a_"))
        return glued.select("map_id", "region_id", "arc_id", "first_edge", "last_edge", "edge_count", "weight")

    def tables(r, a, c):
        r, a, c = map(cut, (r, a, c))
        weights, glued, _ = regions.contract_chords(r, a, c, c.where("chord_id % 4 = 0").select("map_id", "chord_id"))
        return glued.join(weights, ["map_id", "region_id"]).select("map_id", "region_id", "arc_id", "first_edge", "last_edge", "edge_count", "weight")

    return _placed(s, d, rows, tables)
