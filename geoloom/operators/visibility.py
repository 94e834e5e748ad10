"""Horizontal visibility: nearest-hit range joins and the trapezoids they give.

An edge is met at the level of vertex v if its ends' ranks enclose v's rank; ranks settle all ties. An
edge's rank range is cut into dyadic pieces and a vertex looks in its own piece of each grade,
so the join is an equi-join on (pid, grade, piece): exact pairs only, and no crowding on pid, be it
millions of small polygons or one large one. Rays from the vertices of polygons of up to `small` vertices are
answered on one array a polygon, without pairs; other rays there take the plain equi-join on pid. Rays from the
vertices of larger ones are answered on one array a block of 2**GRADE ranks; only edges over whole blocks are met in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packed import HITS, SLOPED, ray_hits, sloped_hits
from ..functions.plane import edge_x, orient2d
from ..plans.iterate import cut
from ..plans.ordered import running
from .chains import holding
from .regions import at_height
from .rings import ring, ring_neighbors, y_extrema

GRADE = 10  # a block's array has up to 2,048 rows: its vertices, and edges that end there
WIDE = 100_000  # ranged: rings of more vertices are sorted in ranges, others take windows


def edges_of(r: DataFrame, closed: bool = True) -> DataFrame:
    """Edges of a ranked ring with both ends and the rank range; an open curve lacks the closing one."""
    rows = r if closed else r.where("next_idx > idx")
    return rows.select("pid", F.col("idx").alias("e"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("next_x").alias("bx"), F.col("next_y").alias("by"), F.least("rk", "next_rk").alias("lo"), F.greatest("rk", "next_rk").alias("hi"), "n")


def _pairs(levels: DataFrame, edges: DataFrame, small: int) -> DataFrame:
    """levels(pid, rk, ...) with every edge whose range encloses rk. levels have n, the polygon's size."""
    few = levels.where(F.col("n") <= small).join(edges.where(F.col("n") <= small).drop("n"), "pid").where("lo < rk and rk < hi")
    return few.unionByName(_met(levels.where(F.col("n") > small), edges.where(F.col("n") > small), 0))


def _met(levels: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """levels with the edges that enclose them by pieces of the grade `least` or above; polygons have 2**least vertices or more."""
    big = edges.drop("n").withColumn("grade", F.explode(F.sequence(F.lit(least), F.lit(40))))
    big = big.withColumn("l", F.expr("shiftright(lo + 1 + shiftleft(1L, grade) - 1, grade)")).withColumn("r", F.expr("shiftright(hi, grade)")).where("l < r")
    left, right = F.when(F.col("l") % 2 == 1, F.col("l")), F.when((F.col("r") % 2 == 1) & ((F.col("r") - 1 > F.col("l")) | (F.col("l") % 2 == 0)), F.col("r") - 1)
    big = big.withColumn("piece", F.explode(F.array_compact(F.array(left, right)))).drop("l", "r")
    ask = levels.withColumn("grade", F.explode(F.sequence(F.lit(least), F.ceil(F.log2("n")).cast("int")))).withColumn("piece", F.expr("shiftright(cast(rk as bigint), grade)"))
    return ask.join(big, ["pid", "grade", "piece"]).drop("grade", "piece")


def nearest(pairs: DataFrame, keys: list[str], x: Column, level: Column) -> DataFrame:
    """hl and hr: the nearest edges left and right of x at the level, and where they are met. Equal places: by slope, as just above the level."""
    return _sloped(pairs, keys, x, level).drop("hl_slope", "hr_slope")


def _sloped(pairs: DataFrame, keys: list[str], x: Column, level: Column) -> DataFrame:
    """What nearest gives, with the slopes of both edges."""
    xi = F.col("ax") + (level - F.col("ay")) * ((F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    p = pairs.withColumn("xi", xi).withColumn("slope", (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    hit = F.struct("e", "xi", "slope")
    return p.groupBy(*keys).agg(
        F.max_by(F.when(F.col("xi") <= x, hit), F.when(F.col("xi") <= x, F.struct("xi", "slope"))).alias("l_"),
        F.min_by(F.when(F.col("xi") >= x, hit), F.when(F.col("xi") >= x, F.struct(F.col("xi"), -F.col("slope")))).alias("r_"),
    ).select(*keys, *[F.col(f"{side}_.{c}").alias(f"h{side}{name}") for side in "lr" for c, name in (("e", ""), ("xi", "_x"), ("slope", "_slope"))])


def _shot(vertices: DataFrame, closed: bool, small: int, ranged: bool) -> DataFrame:
    """The ranked ring with hl, hl_x, hr and hr_x. Rings of up to `small` vertices are an array each, asked where they are: no pairs, and one shuffle for ranks, neighbours and hits. Larger ones are asked in blocks."""
    block = 2**GRADE
    big = cut(vertices.groupBy("pid").agg(F.count("*").alias("n_")).where(F.col("n_") > (small if small > 0 else block - 1)))
    most = big.agg(F.max("n_")).first()[0] or 0

    def ranked(v: DataFrame) -> DataFrame:
        if ranged and most > WIDE:
            wide = big.where(F.col("n_") > WIDE).select("pid")
            r = ring(v.join(wide, "pid", "left_anti")).unionByName(ring(v.join(wide, "pid", "left_semi"), ranged))
        else:
            r = ring(v)
        return r.withColumn("rk", F.col("rk").cast("long")).withColumn("next_rk", F.col("next_rk").cast("long"))

    few = many = None
    if small > 0:
        few = _packed(ranked(vertices.join(big, "pid", "left_anti") if most else vertices), closed)
    if most or small <= 0:
        r = ranked(vertices.join(big, "pid", "left_semi") if small > 0 else vertices)
        many = _by_blocks(cut(r), closed) if most >= block else _packed(r, closed)  # all of one block: an array each
    return few.unionByName(many) if few is not None and many is not None else few if many is None else many


def _packed(r: DataFrame, closed: bool, by: tuple[str, ...] = (), sloped: bool = False) -> DataFrame:
    """The rows with their hits among the edges of one array for each polygon, and each value of `by`. sloped: with hl_slope and hr_slope."""
    edge = F.lit(True) if closed else F.col("next_idx") > F.col("idx")
    asked = F.struct(F.col("idx").alias("e"), "x", "y", "rk", "next_x", "next_y", "next_rk", edge.alias("edge"))
    packed = r.groupBy("pid", *by).agg(F.collect_list(F.struct(*[c for c in r.columns if c != "pid"], asked.alias("asked_"))).alias("v_"))
    packed = packed.withColumn("h_", F.arrow_udf(*((sloped_hits, SLOPED) if sloped else (ray_hits, HITS)))(F.col("v_.asked_"))).select("pid", F.explode(F.arrays_zip("v_", "h_")).alias("z_"))
    return packed.select("pid", "z_.v_.*", "z_.h_.*").select(*r.columns, "hl", "hl_x", "hr", "hr_x", *(["hl_slope", "hr_slope"] if sloped else []))


def _by_blocks(r: DataFrame, closed: bool) -> DataFrame:
    """The rows with their hits: among the edges that begin or end in their block of 2**GRADE ranks on one array a block, among those over the whole block in pieces of that grade or above."""
    end = F.lit(True) if closed else F.col("next_idx") > F.col("idx")
    blocks = F.array_compact(F.array_distinct(F.array("own_", F.when(end, F.shiftright("next_rk", GRADE)))))
    near = _packed(r.withColumn("own_", F.shiftright("rk", GRADE)).withColumn("block_", F.explode(blocks)), closed, ("block_",), True).where("own_ = block_")
    several = F.col("n") >= 2**GRADE
    asks, over = r.select("pid", "idx", "x", "y", "rk", "n").where(several), edges_of(r, closed).where(several)
    far = _sloped(_met(asks, over, GRADE), ["pid", "idx", "x", "y"], F.col("x"), F.col("y"))
    names = [f"h{side}{c}" for side in "lr" for c in ("", "_x", "_slope")]
    both = near.join(far.select("pid", "idx", *[F.col(c).alias(f"far_{c}") for c in names]), ["pid", "idx"], "left")

    def nearer(side: str, sign: int) -> Column:
        hit = lambda far_: F.struct((F.col(f"{far_}h{side}_x") * sign).alias("at"), F.col(f"{far_}h{side}_slope").alias("slope"), F.col(f"{far_}h{side}").alias("e"))
        return F.greatest(hit(""), hit("far_"))  # without an edge: null, which is least

    both = both.withColumns({"l_": nearer("l", 1), "r_": nearer("r", -1)})
    return both.select(*r.columns, F.col("l_.e").alias("hl"), F.col("l_.at").alias("hl_x"), F.col("r_.e").alias("hr"), (-F.col("r_.at")).alias("hr_x"))


def ray_shoot(vertices: DataFrame, closed: bool = True, small: int = 2000, ranged: bool = False) -> DataFrame:
    """For every vertex the nearest edge to its left (hl) and right (hr) at its height; null if there is none. ranged: for giant rings, see rings.y_rank."""
    return _shot(vertices, closed, small, ranged).select("pid", "idx", "x", "y", "hl", "hl_x", "hr", "hr_x")


def _heights(rays: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rays, edges) with the heights of both numbered together in each polygon: an edge is met if lo < rk < hi, that is from its lower end on, up to but without its upper end."""
    v = vertices.select("pid", "idx", "x", "y").withColumn("ray_", F.lit(False))
    both = v.unionByName(rays.withColumn("ray_", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("pid")
    both = both.withColumn("rk", F.dense_rank().over(w.orderBy("y")).cast("long")).withColumn("n", F.count("*").over(w))
    r = ring_neighbors(both.where("not ray_").select("pid", "idx", "x", "y", "rk", F.col("n").alias("n_")), ("idx", "x", "y", "rk"))
    e = edges_of(r.withColumn("n", F.col("n_"))).withColumn("lo", F.col("lo") - 1)
    return both.where("ray_").select(*rays.columns, "rk", "n"), e


def shoot_from_point(rays: DataFrame, vertices: DataFrame, small: int = 2000) -> DataFrame:
    """Rays (pid, ray_id, x, y) from free points: nearest edges left and right. An edge covers heights from its lower end on, up to but without its upper end."""
    asked, e = _heights(rays.select("pid", "ray_id", "x", "y"), vertices)
    hits = nearest(_pairs(asked, e, small), ["pid", "ray_id"], F.col("x"), F.col("y"))
    return rays.select("pid", "ray_id").join(hits, ["pid", "ray_id"], "left")


def shoot_from_edge(rays: DataFrame, vertices: DataFrame, small: int = 2000) -> DataFrame:
    """Rays (pid, ray_id, e, y) from a point of edge e: x by the edge, then the nearest other edges."""
    e = ring_neighbors(vertices).select("pid", F.col("idx").alias("own"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("next_x").alias("qx"), F.col("next_y").alias("qy"))
    start = rays.withColumnRenamed("e", "own").join(e, ["pid", "own"]).withColumn("x", edge_x("ox", "oy", "qx", "qy", "y")).select("pid", "ray_id", "own", "x", "y")
    asked, other = _heights(start, vertices)
    hits = nearest(_pairs(asked, other, small).where("e <> own"), ["pid", "ray_id"], F.col("x"), F.col("y"))
    return start.select("pid", "ray_id", "x").join(hits, ["pid", "ray_id"], "left")


def shoot_chords(rays: DataFrame, chords: DataFrame, hits: DataFrame) -> DataFrame:
    """Rays (pid, ray_id, x, y, side) against chords (pid, chord_id, y, x1, x2) at exactly the same height, in competition with edge hits (pid, ray_id, e, hit_x)."""
    sign = F.when(F.col("side") == "L", -1).otherwise(1)
    near = F.when(F.col("side") == "L", F.greatest("x1", "x2")).otherwise(F.least("x1", "x2"))
    c = rays.join(chords, ["pid", "y"]).withColumn("hit_x", near).where((F.col("hit_x") - F.col("x")) * sign >= 0)
    c = c.select("pid", "ray_id", F.lit("CHORD").alias("hit_type"), F.col("chord_id").alias("hit_id"), "hit_x", F.abs(F.col("hit_x") - F.col("x")).alias("d"))
    e = rays.join(hits, ["pid", "ray_id"]).where("e is not null").select("pid", "ray_id", F.lit("ARC").alias("hit_type"), F.col("e").alias("hit_id"), "hit_x", F.abs(F.col("hit_x") - F.col("x")).alias("d"))
    best = F.min_by(F.struct("hit_type", "hit_id", "hit_x"), F.struct("d", F.col("hit_type") == "ARC", "hit_id"))
    won = c.unionByName(e).groupBy("pid", "ray_id").agg(best.alias("b")).select("pid", "ray_id", "b.*")
    return rays.select("pid", "ray_id").join(won, ["pid", "ray_id"], "left")


def visibility_chords(vertices: DataFrame, closed: bool = True) -> DataFrame:
    """A chord from each vertex to what it sees on each side: (pid, vertex, y, side, left_edge, right_edge)."""
    s = ray_shoot(vertices, closed)
    each = s.select("pid", F.col("idx").alias("vertex"), "y", F.explode(F.array(F.struct(F.lit("L").alias("side"), F.col("hl").alias("left_edge"), F.col("idx").alias("right_edge")), F.struct(F.lit("R").alias("side"), F.col("idx").alias("left_edge"), F.col("hr").alias("right_edge")))).alias("c"))
    return each.select("pid", "vertex", "y", "c.*").where("left_edge is not null and right_edge is not null")


def null_length_chords(vertices: DataFrame, closed: bool = True) -> DataFrame:
    """A chord of no length at each local extremum."""
    e = y_extrema(vertices, closed).where("kind <> 'neither'")
    return e.select("pid", F.col("idx").alias("vertex"), "y", F.col("idx").alias("left_edge"), F.col("idx").alias("right_edge"), F.lit(True).alias("is_null_length"))


def cross_chain_visibility(vertices: DataFrame, chain: str, small: int = 2000) -> DataFrame:
    """Vertices of either chain (column `chain`, 0 or 1, by edge start) that see the other chain before their own: (pid, idx, side, e)."""
    r = ring(vertices)
    names = r.select("pid", "idx", chain)
    e = edges_of(r, closed=False).join(names.select("pid", F.col("idx").alias("e"), F.col(chain).alias("on")), ["pid", "e"])
    p = _pairs(r.select("pid", "idx", "x", "y", F.col("rk").cast("long").alias("rk"), "n", F.col(chain).alias("of")), e, small)
    own = nearest(p.where("of = on"), ["pid", "idx", "x", "y"], F.col("x"), F.col("y"))
    other = nearest(p.where("of <> on"), ["pid", "idx", "x", "y"], F.col("x"), F.col("y"))
    both = other.join(own.select("pid", "idx", F.col("hl_x").alias("ol"), F.col("hr_x").alias("orx")), ["pid", "idx"], "left")
    left = both.where("hl is not null and (ol is null or hl_x >= ol)").select("pid", "idx", F.lit("L").alias("side"), F.col("hl").alias("e"))
    right = both.where("hr is not null and (orx is null or hr_x <= orx)").select("pid", "idx", F.lit("R").alias("side"), F.col("hr").alias("e"))
    return left.unionByName(right)


def trapezoids(vertices: DataFrame, small: int = 2000, ranged: bool = False, heights: bool = False) -> DataFrame:
    """The inside of each counter-clockwise polygon as trapezoids (pid, top_v, bottom_v, left_edge, right_edge): n - 1 for n vertices. heights: with top_y and bottom_y.

    A vertex ends and begins trapezoids by how its edges run; a trapezoid is known by its two
    edges, and along these begins and ends alternate from high to low."""
    v = _shot(vertices, True, small, ranged).withColumn("turn", orient2d("prev_x", "prev_y", "x", "y", "next_x", "next_y"))
    ep, en, hl, hr = F.col("prev_idx"), F.col("idx"), F.col("hl"), F.col("hr")
    pa, na = F.col("prev_rk") > F.col("rk"), F.col("next_rk") > F.col("rk")
    convex = F.col("turn") > 0

    def event(begins: bool, left: Column, right: Column) -> Column:
        return F.struct(F.lit(begins).alias("begins"), left.cast("long").alias("left_edge"), right.cast("long").alias("right_edge"))

    end, begin = (lambda a, b: event(False, a, b)), (lambda a, b: event(True, a, b))
    events = (
        F.when(pa & ~na, F.array(end(ep, hr), begin(en, hr)))
        .when(~pa & na, F.array(end(hl, en), begin(hl, ep)))
        .when(~pa & ~na & convex, F.array(begin(en, ep)))
        .when(~pa & ~na, F.array(end(hl, hr), begin(hl, ep), begin(en, hr)))
        .when(convex, F.array(end(ep, en)))
        .otherwise(F.array(end(hl, en), end(ep, hr), begin(hl, hr)))
    )
    flat = v.select("pid", "idx", "rk", "y", F.explode(events).alias("t")).select("pid", "idx", "rk", "y", "t.*")
    w = Window.partitionBy("pid", "left_edge", "right_edge").orderBy(F.desc("rk"))
    flat = flat.withColumns({"bottom_v": F.lead("idx").over(w), "bottom_y": F.lead("y").over(w)}).where("begins")
    return flat.select("pid", F.col("idx").alias("top_v"), "bottom_v", "left_edge", "right_edge", *([F.col("y").alias("top_y"), "bottom_y"] if heights else []))


def region_tables(vertices: DataFrame, traps: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, arcs, chords) of the visibility map inside counter-clockwise polygons; map_id is the pid.

    A region is a trapezoid: its id is twice its top vertex, and one more if the edge that starts there is its left side. Its arcs are its
    left (L) and right (R) side, with the heights of their ends; an arc of no height has an edge count of 0. A chord lies at a
    vertex, between a region that ends and one that begins there; its id is twice the vertex, and one more to the right of it. A
    convex extremum has a chord of no length, with the one region on both sides. Regions are one more than chords of a length."""
    t = trapezoids(vertices, heights=True) if traps is None else traps
    if "top_y" not in t.columns:
        for c in ("top", "bottom"):
            t = t.join(vertices.select("pid", F.col("idx").alias(f"{c}_v"), F.col("y").alias(f"{c}_y")), ["pid", f"{c}_v"])
    t = t.select(F.col("pid").alias("map_id"), "pid", (F.col("top_v") * 2 + (F.col("left_edge") == F.col("top_v")).cast("long")).alias("region_id"), "top_v", "bottom_v", "left_edge", "right_edge", "top_y", "bottom_y")
    t = cut(t.drop("pid"))
    side = lambda k, s, e, first, last: F.struct((F.col("region_id") * 2 + k).alias("arc_id"), F.col("region_id"), F.col(e).alias("first_edge"), F.col(e).alias("last_edge"), F.lit(s).alias("first_side"), F.lit(s).alias("last_side"), (F.col("top_y") > F.col("bottom_y")).cast("long").alias("edge_count"), F.col(first).alias("y_first"), F.col(last).alias("y_last"))
    arcs = t.select("map_id", F.inline(F.array(side(0, "L", "left_edge", "top_y", "bottom_y"), side(1, "R", "right_edge", "bottom_y", "top_y"))))
    over = t.select("map_id", F.col("bottom_v").alias("vertex"), F.col("region_id").alias("region_a"), F.col("left_edge").alias("la"), F.col("right_edge").alias("ra"), F.col("bottom_y").alias("y"))
    under = t.select("map_id", F.col("top_v").alias("vertex"), F.col("region_id").alias("region_b"), F.col("left_edge").alias("lb"), F.col("right_edge").alias("rb"), F.col("top_y").alias("y"))
    left = F.col("la") == F.col("lb")
    met = over.join(under.drop("y"), ["map_id", "vertex"])
    chords = met.select("map_id", (F.col("vertex") * 2 + (~left).cast("long")).alias("chord_id"), "region_a", "region_b", F.when(left, F.col("la")).otherwise(F.col("vertex")).alias("left_edge"), F.when(left, F.col("vertex")).otherwise(F.col("ra")).alias("right_edge"), "y", F.lit(False).alias("is_null_length"))
    alone = over.select("map_id", "vertex", F.col("region_a").alias("r"), "y").join(under.select("map_id", "vertex"), ["map_id", "vertex"], "left_anti").unionByName(under.select("map_id", "vertex", F.col("region_b").alias("r"), "y").join(over.select("map_id", "vertex"), ["map_id", "vertex"], "left_anti"))
    null = alone.select("map_id", (F.col("vertex") * 2).alias("chord_id"), F.col("r").alias("region_a"), F.col("r").alias("region_b"), F.col("vertex").alias("left_edge"), F.col("vertex").alias("right_edge"), "y", F.lit(True).alias("is_null_length"))
    return t.select("map_id", "region_id"), arcs, chords.unionByName(null)


def locate_by_height(queries: DataFrame, chords: DataFrame, ranged: bool = False) -> DataFrame:
    """region for queries (map_id, query_id, y): above the last chord (map_id, y, above, below) with a smaller y, else below the lowest. One sort a map, no range join. ranged: for giant maps, see plans.ordered."""
    q = queries.select("map_id", "y", F.lit(0).alias("kind"), "query_id", F.lit(None).cast("long").alias("above"), F.lit(None).cast("long").alias("below"))
    c = chords.select("map_id", "y", F.lit(1).alias("kind"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "above", "below")
    both = q.unionByName(c)
    if ranged:
        known = F.col("above").isNotNull().cast("long")
        both = cut(running(both, ["map_id"], [F.col("y"), F.col("kind"), F.col("above")], {"nth": known}))
        last = both.where("above is not null").select("map_id", "nth", F.col("above").alias("up"))
        low = c.where("below is not null").groupBy("map_id").agg(F.min_by("below", "y").alias("low"))
        return both.where("kind = 0").join(last, ["map_id", "nth"], "left").join(low, "map_id", "left").select("map_id", "query_id", F.coalesce("up", "low").alias("region"))
    w = Window.partitionBy("map_id").orderBy("y", "kind")
    up = F.last("above", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    lowest = F.first("below", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn("region", F.coalesce(up, lowest)).where("kind = 0").select("map_id", "query_id", "region")


def region_locate_on_edge(queries: DataFrame, arcs: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """region for queries (map_id, query_id, e, side): the lowest one with an arc whose edge range holds e on that side; null where there is none.

    With y in queries, and y_first and y_last in arcs, arcs elsewhere on the edge don't count; see regions.at_height."""
    placed = "y" in queries.columns and "y_first" in arcs.columns
    more = ["first_edge", "last_edge", "y_first", "y_last"] if placed else []
    a = arcs.select("map_id", "region_id", F.least("first_edge", "last_edge").alias("lo"), F.greatest("first_edge", "last_edge").alias("hi"), F.col("first_side").alias("side"), *more)
    hit = holding(queries, a, ["map_id", "side"], F.col("e"), F.col("lo"), F.col("hi"))
    if placed:
        hit = at_height(hit, ends)
    found = hit.groupBy("map_id", "query_id").agg(F.min("region_id").alias("region"))
    return queries.select("map_id", "query_id").distinct().join(found, ["map_id", "query_id"], "left")
