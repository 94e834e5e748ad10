"""Embedded graphs, parallel edges and loops included, as darts: each edge is two, one for each way.

darts(gid, d, twin, tail, head, pos): d and twin are structs (k, a, b, s), where (k, a, b) names the edge and s its way; pos
(of any type that can be sorted) grows clockwise around the tail. All graphs of a table are worked on together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut
from ..plans.ordered import running
from .walks import faces, lowest_common, tree_path


def name(k: Column, a: Column, b: Column, s: Column) -> Column:
    return F.struct(k.cast("long").alias("k"), a.cast("long").alias("a"), b.cast("long").alias("b"), s.cast("int").alias("s"))


def darts_of(half: DataFrame) -> DataFrame:
    """Darts of half-edges (gid, tail, head, pos) of a simple graph: k is 0, a and b are the lower and the higher vertex."""
    low, high, s = F.least("tail", "head"), F.greatest("tail", "head"), (F.col("tail") > F.col("head")).cast("int")
    return half.select("gid", name(F.lit(0), low, high, s).alias("d"), name(F.lit(0), low, high, 1 - s).alias("twin"), "tail", "head", "pos")


def darts_of_edges(e: DataFrame) -> DataFrame:
    """Darts of edges (gid, e, u, v, pos_u, pos_v) with ids of their own, so that there may be parallel ones and loops: k is 0, a the id, and s is 0 from u to v."""
    both = [F.struct(name(F.lit(0), F.col("e"), F.lit(0), F.lit(s)).alias("d"), name(F.lit(0), F.col("e"), F.lit(0), F.lit(1 - s)).alias("twin"), F.col(t).alias("tail"), F.col(h).alias("head"), F.col(f"pos_{t}").alias("pos")) for s, t, h in ((0, "u", "v"), (1, "v", "u"))]
    return e.select("gid", F.inline(F.array(*both)))


def around(darts: DataFrame) -> DataFrame:
    """Adds p, the place of each dart around its tail from 1, and cw and ccw, the darts behind and before it there."""
    w = Window.partitionBy("gid", "tail").orderBy("pos", "d")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return darts.withColumns({"p": F.row_number().over(w).cast("long"), "cw": F.coalesce(F.lead("d").over(w), F.first("d").over(whole)), "ccw": F.coalesce(F.lag("d").over(w), F.last("d").over(whole))})


def dart_faces(turns: DataFrame) -> DataFrame:
    """(gid, d, face, pos, size) for darts with cw: behind a dart comes the one clockwise of its twin; face is the lowest dart of the walk."""
    turn = turns.select("gid", F.col("d").alias("twin"), F.col("cw").alias("next"))
    return faces(turns.select("gid", "d", "twin").join(turn, ["gid", "twin"]).select("gid", F.col("d").alias("h"), "next")).withColumnRenamed("h", "d")


def inserted(e: DataFrame, most: int = 60) -> DataFrame:
    """Darts with rotations as they grow when edges (gid, e, u, v, after_u, after_v) are put in by ascending e.

    An end goes right behind (clockwise) the end that an edge put in before has at that vertex; where after is null, in
    front of the vertex's first end. Of a loop named by after, its end at u counts. Both ends of a loop are put in, u first, and
    after_v may name the loop itself.

    Ends put in behind the same one lie in descending order, so the rotation is the order of a tree walk that takes
    the last child first: the ends behind null, in ascending order, and behind each all that hang on it. The place in that walk
    is found by doubling along its links."""
    ends = lambda s, c: e.select("gid", F.col(c).alias("at"), F.struct(F.col("e").cast("long").alias("e"), F.lit(s).alias("s")).alias("x"), F.col(f"after_{c}").alias("after"))
    x = ends(0, "u").unionByName(ends(1, "v"))
    target = x.select("gid", "at", F.col("x.e").alias("after"), F.col("x.s").alias("s")).groupBy("gid", "at", "after").agg(F.min("s").alias("s"))
    x = x.join(target, ["gid", "at", "after"], "left").withColumn("up", F.when(F.col("after").isNotNull() & F.col("s").isNotNull(), F.struct(F.col("after").cast("long").alias("e"), F.col("s"))))
    x = cut(x.select("gid", "at", "x", "up", F.col("after").isNotNull().alias("named")))
    if not x.where("named and (up is null or up >= x)").isEmpty():
        raise ValueError("an edge is named by after that has no end at that vertex before it")
    first = Window.partitionBy("gid", "at", "up").orderBy(F.when(F.col("up").isNull(), F.col("x.e")).otherwise(-F.col("x.e")), F.when(F.col("up").isNull(), F.col("x.s")).otherwise(-F.col("x.s")))
    x = x.withColumn("sibling", F.lead("x").over(first)).withColumn("nth", F.row_number().over(first))
    child = x.where("nth = 1 and up is not null").select("gid", F.col("up").alias("x"), F.col("x").alias("child"))
    # the walk passes each end twice, going down (0) and coming back (1)
    step = lambda i, end: F.struct(F.lit(i).alias("back"), end.alias("x"))
    links = cut(x.join(child, ["gid", "x"], "left"))
    top = links.where("up is null and nth = 1").select("gid", "at", F.col("x").alias("start"))
    links = links.join(top, ["gid", "at"])
    down = links.select("gid", step(0, F.col("x")).alias("h"), F.when(F.col("child").isNotNull(), step(0, F.col("child"))).otherwise(step(1, F.col("x"))).alias("next"))
    back = links.select("gid", step(1, F.col("x")).alias("h"), F.when(F.col("sibling").isNotNull(), step(0, F.col("sibling"))).when(F.col("up").isNotNull(), step(1, F.col("up"))).otherwise(step(0, F.col("start"))).alias("next"))
    walk = cut(faces(down.unionByName(back), most))
    begin = walk.join(top.select("gid", step(0, F.col("start")).alias("h")), ["gid", "h"]).select("gid", "face", F.col("pos").alias("zero"))
    place = walk.where("h.back = 0").join(begin, ["gid", "face"]).select("gid", F.col("h.x").alias("x"), F.pmod(F.col("pos") - F.col("zero"), F.col("size")).alias("place"))
    pos = lambda s, c: place.where(f"x.s = {s}").select("gid", F.col("x.e").alias("e"), F.col("place").alias(f"pos_{c}"))
    return darts_of_edges(e.withColumn("e", F.col("e").cast("long")).join(pos(0, "u"), ["gid", "e"]).join(pos(1, "v"), ["gid", "e"]))


def triangulated(darts: DataFrame) -> DataFrame:
    """Darts with edges put into every face of more than three sides, from its first vertex to all others that it isn't next to (on a walk that
    passes a vertex again these may be parallel edges or loops). pos becomes a struct."""
    turns = cut(around(darts))
    place = turns.select("gid", "d", "tail", "p")
    walk = cut(dart_faces(turns).where("size > 3").join(place, ["gid", "d"]))
    apex = walk.where("pos = 0").select("gid", "face", F.col("tail").alias("apex"), F.col("p").alias("apex_p"))
    new = walk.where("pos >= 2 and pos <= size - 2").join(apex, ["gid", "face"])
    edge = lambda s: name(F.col("pos") * 2 + F.col("face.s"), F.col("face.a"), F.col("face.b"), F.lit(s))
    at = lambda p, q: F.struct(p.cast("long").alias("p"), q.cast("long").alias("q"))
    # at the first vertex new edges lie in front of the face's first dart, the last vertex first; at the others in front of the face's next dart
    there = F.struct(edge(0).alias("d"), edge(1).alias("twin"), F.col("apex").alias("tail"), F.col("tail").alias("head"), at(F.col("apex_p"), -F.col("pos")).alias("pos"))
    back = F.struct(edge(1).alias("d"), edge(0).alias("twin"), F.col("tail").alias("tail"), F.col("apex").alias("head"), at(F.col("p"), F.lit(-1)).alias("pos"))
    old = turns.select("gid", "d", "twin", "tail", "head", at(F.col("p"), F.lit(0)).alias("pos"))
    return old.unionByName(new.select("gid", F.inline(F.array(there, back))))


def tree_darts(darts: DataFrame, tree: DataFrame) -> DataFrame:
    """Adds linked: whether the dart's edge is one of tree(gid, v, parent); of parallel edges the lowest."""
    up = tree.where("parent is not null").select("gid", F.least("v", "parent").alias("low"), F.greatest("v", "parent").alias("high"), F.lit(True).alias("of_tree"))
    ends = darts.withColumns({"low": F.least("tail", "head"), "high": F.greatest("tail", "head"), "edge": F.least("d", "twin")})
    link = ends.join(up, ["gid", "low", "high"]).groupBy("gid", "low", "high").agg(F.min("edge").alias("edge")).select("gid", "edge", F.lit(True).alias("linked"))
    return ends.drop("low", "high").join(link, ["gid", "edge"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))).drop("edge")


def walk_around(turns: DataFrame) -> DataFrame:
    """(gid, d, face, pos, size) of the walk around a tree, for darts with cw and linked: along a linked dart, past any other. face is the lowest (tail, d)."""
    turn = turns.select("gid", F.col("d").alias("twin"), F.col("tail").alias("to"), F.col("cw").alias("turn"))
    after = F.when(F.col("linked"), F.struct(F.col("to").alias("tail"), F.col("turn").alias("d"))).otherwise(F.struct("tail", F.col("cw").alias("d")))
    walk = faces(turns.join(turn, ["gid", "twin"]).select("gid", F.struct("tail", "d").alias("h"), after.alias("next")))
    return walk.select("gid", "h.d", "face", "pos", "size")


def dart_cycles(v: DataFrame, darts: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((gid, d, u, v, common, inside, outside, on_cycle), (gid, v, parent, level)): what both sides of the cycle and the cycle itself weigh, for the cycle that each edge outside a
    spanning tree closes; and the tree with levels. tree: (gid, v, parent), one for each component.

    One walk around the tree passes all darts. Between both passes of an edge it stays on one side of its cycle, and the
    vertices first met there are those inside and the path below the lowest common ancestor; so all
    sides are differences of running sums. The side away from the walk's start, the lowest vertex, is `inside`."""
    h = cut(around(tree_darts(darts, tree)).select("gid", "d", "twin", "tail", "head", "linked", "cw"))
    walk = cut(walk_around(h).select("gid", "d", "face", "pos").join(h.drop("cw"), ["gid", "d"]))
    cost = v.select("gid", "v", "cost")
    w = walk.join(walk.select("gid", F.col("d").alias("twin"), F.col("pos").alias("back")), ["gid", "twin"])
    w = w.join(cost.select("gid", F.col("v").alias("head"), F.col("cost").alias("hc")), ["gid", "head"]).join(cost.select("gid", F.col("v").alias("tail"), F.col("cost").alias("tc")), ["gid", "tail"])
    down, upward = F.col("linked") & (F.col("pos") < F.col("back")), F.col("linked") & (F.col("pos") > F.col("back"))
    sums = {"met": F.when(down, F.col("hc")).otherwise(0.0), "below": F.when(down, F.col("hc")).when(upward, -F.col("tc")).otherwise(0.0), "level": F.when(down, 1).when(upward, -1).otherwise(0).cast("long")}
    w = running(w.withColumn("down", down), ["gid", "face"], [F.col("pos")], sums)
    tops = walk.where("pos = 0").join(cost.withColumnRenamed("v", "tail"), ["gid", "tail"]).select("gid", "face", F.col("tail").alias("top"), F.col("cost").alias("top_cost"))
    w = cut(w.join(tops, ["gid", "face"]).withColumn("chain", F.col("below") + F.col("top_cost")))
    lower = w.where("down").select("gid", F.col("head").alias("v"), F.col("tail").alias("parent"), "chain", "level")
    roots = tops.select("gid", F.col("top").alias("v"), F.lit(None).cast("long").alias("parent"), F.col("top_cost").alias("chain"), F.lit(0).cast("long").alias("level"))
    rooted = cut(lower.unionByName(roots).join(cost, ["gid", "v"]))
    total = w.groupBy("gid", "face").agg((F.sum(F.when(F.col("down"), F.col("hc")).otherwise(0.0)) + F.max("top_cost")).alias("total"))
    first = w.where("not linked and pos < back").select("gid", "face", "d", F.col("tail").alias("u"), F.col("head").alias("v"), F.col("met").alias("met_u"), F.col("chain").alias("chain_u"))
    second = w.where("not linked and pos > back").select("gid", F.col("twin").alias("d"), F.col("met").alias("met_v"), F.col("chain").alias("chain_v"))
    c = lowest_common(first.join(second, ["gid", "d"]).join(total, ["gid", "face"]), rooted, rooted)
    c = c.join(rooted.select("gid", F.col("v").alias("common"), F.col("chain").alias("chain_c"), F.col("cost").alias("cost_c")), ["gid", "common"])
    inside = F.col("met_v") - F.col("met_u") - (F.col("chain_v") - F.col("chain_c"))
    on = F.col("chain_u") + F.col("chain_v") - 2 * F.col("chain_c") + F.col("cost_c")
    return c.select("gid", "d", "u", "v", "common", inside.alias("inside"), (F.col("total") - inside - on).alias("outside"), on.alias("on_cycle")), rooted.select("gid", "v", "parent", "level")


def cycle_costs(v: DataFrame, half: DataFrame, tree: DataFrame) -> DataFrame:
    """(gid, u, v, inside, outside, on_cycle) of dart_cycles, for an embedding (gid, tail, head, pos) of a simple graph."""
    return dart_cycles(v, darts_of(half), tree)[0].select("gid", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "inside", "outside", "on_cycle")


def best_cycle(v: DataFrame, half: DataFrame, tree: DataFrame) -> DataFrame:
    """The cycle of each graph whose larger side weighs least (see dart_cycles); ties: the lowest edge (u, v). Graphs without a cycle give no row.

    In a triangulated connected graph neither side is above two thirds of the cost."""
    c = cycle_costs(v, half, tree).withColumn("larger", F.greatest("inside", "outside"))
    return c.groupBy("gid").agg(F.min_by(F.struct("u", "v", "inside", "outside", "on_cycle", "larger"), F.struct("larger", "u", "v")).alias("b")).select("gid", "b.*")


def between_levels(v: DataFrame, levels: DataFrame, chosen: DataFrame, half: DataFrame) -> DataFrame:
    """(gid, v): vertices between the levels l0 and l2 of a breadth-first tree that divide what lies there, in graphs where it weighs over two thirds (of 1).

    The levels below l2 are triangulated, those up to l0 cost nothing, and the best cycle of the tree is taken: neither of its sides
    weighs more than two thirds. It has at most two vertices on a level; those up to l0 need not go, for whoever would pass
    there passes level l0. That stands for merging these levels into one vertex."""
    placed = v.join(levels, ["gid", "v"]).join(chosen.select("gid", "l0", "l2"), "gid").where("level < l2")
    heavy = placed.where("level > l0").groupBy("gid").agg(F.sum("cost").alias("middle")).where("middle * 3 > 2 + 1e-9").select("gid")
    placed = cut(placed.join(heavy, "gid", "left_semi"))
    if placed.isEmpty():
        return placed.select("gid", "v")
    darts = darts_of(half)
    for end in ("tail", "head"):
        darts = darts.join(placed.select("gid", F.col("v").alias(end)), ["gid", end], "left_semi")
    cost = placed.select("gid", "v", F.when(F.col("level") > F.col("l0"), F.col("cost")).otherwise(0.0).alias("cost"))
    cycles, tree = dart_cycles(cost, cut(triangulated(cut(darts))), placed.select("gid", "v", "parent"))
    best = cycles.groupBy("gid").agg(F.min_by(F.struct("u", "v"), F.struct(F.greatest("inside", "outside"), "u", "v", "d")).alias("b"))
    path = tree_path(best.select("gid", F.lit(1).alias("pair"), "b.u", "b.v"), tree)
    return path.select("gid", F.col("vertex").alias("v")).join(placed.where("level > l0"), ["gid", "v"], "left_semi")


def shrink_embedded(v: DataFrame, darts: DataFrame, inside: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g_vertices, darts): each graph's connected vertices of inside(gid, v) become their lowest one, of cost 0, with the rotation kept.

    tree(gid, v, parent): a spanning tree of them. The darts that leave them, in the order of a walk around the tree, are
    the rotation of the new vertex; of several to one outside vertex the first stays."""
    low = inside.groupBy("gid").agg(F.min("v").alias("into"))
    m = inside.select("gid", "v").distinct().join(low, "gid")
    at = F.struct(F.col("p").alias("p"), F.lit(0).cast("long").alias("q"))
    flags = around(tree_darts(darts, tree))
    for end in ("tail", "head"):
        flags = flags.join(m.select("gid", F.col("v").alias(end), F.col("into").alias(f"{end}_into")), ["gid", end], "left")
    flags = cut(flags.withColumn("pos", at))
    # the walk stays on darts that begin inside
    own = flags.where("tail_into is not null").select("gid", "d", "twin", "tail", "head", "cw", "head_into", (F.col("linked") & F.col("head_into").isNotNull()).alias("linked"))
    turn = own.select("gid", F.col("d").alias("twin"), F.col("cw").alias("turn"))
    after = F.when(F.col("linked"), F.col("turn")).otherwise(F.col("cw"))
    walk = faces(own.join(turn, ["gid", "twin"], "left").select("gid", F.col("d").alias("h"), after.alias("next")))
    out = walk.withColumnRenamed("h", "d").join(flags.where("tail_into is not null and head_into is null").select("gid", "d", "twin", F.col("tail_into").alias("tail"), "head"), ["gid", "d"])
    kept = out.groupBy("gid", "tail", "head").agg(F.min_by(F.struct("d", "twin", "pos"), "pos").alias("x"))
    kept = cut(kept.select("gid", "x.d", "x.twin", "tail", "head", F.struct(F.col("x.pos").alias("p"), F.lit(0).cast("long").alias("q")).alias("pos")))
    back = flags.join(kept.select("gid", F.col("twin").alias("d"), F.col("tail").alias("new_head")), ["gid", "d"]).select("gid", "d", "twin", "tail", F.col("new_head").alias("head"), "pos")
    rest = flags.where("tail_into is null and head_into is null").select("gid", "d", "twin", "tail", "head", "pos")
    vertices = v.join(m, ["gid", "v"], "left").where("into is null or into = v").select("gid", "v", F.when(F.col("into").isNotNull(), 0.0).otherwise(F.col("cost")).alias("cost"))
    return vertices, rest.unionByName(kept.select("gid", "d", "twin", "tail", "head", "pos")).unionByName(back)
