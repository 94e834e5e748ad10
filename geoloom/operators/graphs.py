"""Planar graph tables: g_vertices(gid, v, cost) and g_edges(gid, u, v). All graphs of a table are worked on together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType, StringType

from ..functions.divide import divider
from ..functions.packed import levels as reached
from ..functions.packed import lowest, nearby
from ..plans.iterate import counted, cut
from .darts import best_cycle, between_levels, cycle_costs, darts_of  # noqa: F401
from .walks import by_size, faces, lowest_common, tree_path  # noqa: F401


def undirected_edges(e: DataFrame) -> DataFrame:
    """Each pair of different vertices once, the lower id first."""
    return e.where("u <> v").select("gid", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("gid", "u", "v").unionByName(e.select("gid", F.col("v").alias("u"), F.col("u").alias("v")))


def degree(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy("gid", F.col("u").alias("v")).agg(F.count("*").alias("degree"))


def rotation(half: DataFrame) -> DataFrame:
    """cw and ccw neighbours around each tail for half-edges (gid, tail, head, pos); pos grows clockwise."""
    w = Window.partitionBy("gid", "tail").orderBy("pos", "head")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return half.withColumn("cw", F.coalesce(F.lead("head").over(w), F.first("head").over(whole))).withColumn("ccw", F.coalesce(F.lag("head").over(w), F.last("head").over(whole)))


def embedded_faces(half: DataFrame) -> DataFrame:
    """Faces of an embedded graph, with tail and head of each half-edge: after (u, v) comes the clockwise neighbour of u at v."""
    r = rotation(half)
    after = r.select("gid", F.struct(F.col("head").alias("tail"), F.col("tail").alias("head")).alias("h"), F.struct("tail", F.col("cw").alias("head")).alias("next"))
    return faces(after).select("gid", "h.tail", "h.head", "face", "pos", "size")


def live_subgraph(v: DataFrame, e: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of keep(gid, v), and the edges with both ends there."""
    k = keep.select("gid", "v").distinct()
    return v.join(k, ["gid", "v"], "left_semi"), e.join(k, ["gid", "v"], "left_semi").join(k.withColumnRenamed("v", "u"), ["gid", "u"], "left_semi").select(*e.columns)


def _packed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gid").agg(F.collect_list(F.struct("v", "to")).alias("g_"))


def components(v: DataFrame, e: DataFrame, most: int = 60, small: int = 20_000) -> DataFrame:
    """(gid, v, component): the lowest vertex reachable. Graphs of up to `small` vertices and edges are an array each; larger ones by rounds, see _contracted."""
    if v.schema["v"].dataType != LongType():
        return _contracted(v, e, most)
    none = F.lit(None).cast("long")
    rows = cut(v.select("gid", "v", none.alias("to")).unionByName(e.select("gid", F.col("u").cast("long").alias("v"), F.col("v").cast("long").alias("to"))))
    few, large = by_size(rows, small)
    few = _packed(few).withColumn("c_", F.arrow_udf(lowest, "array<struct<v:bigint,component:bigint>>")("g_")).select("gid", F.inline("c_"))
    if large is None:
        return cut(few, rows)
    return cut(few.unionByName(_by_blocks(rows.join(F.broadcast(large), "gid", "left_semi"), most)))


def _by_blocks(rows: DataFrame, most: int, block: int = 500_000) -> DataFrame:
    """Components of giant graphs, for rows of vertices (gid, v, null) and edges (gid, v, to).

    Rows are sorted in ranges by (gid, v), and each block of a range is settled where it lies; only vertices that lie in several blocks link
    what is left, and these links are contracted, see _contracted. So where ids of neighbours are near, few rows are left for the rounds."""
    if not isinstance(rows.schema["gid"].dataType, (IntegralType, StringType)):
        return _contracted(rows.where("to is null").select("gid", "v"), rows.where("to is not null").select("gid", F.col("v").alias("u"), F.col("to").alias("v")), most)
    near = rows.repartitionByRange("gid", "v").sortWithinPartitions("gid", "v").mapInArrow(nearby(block), f"gid {rows.schema['gid'].dataType.simpleString()}, v bigint, low bigint, own boolean")
    of = Window.partitionBy("gid", "v")
    near = near.withColumns({"nth": F.row_number().over(of.orderBy("low")), "to": F.min("low").over(of), "own": F.max("own").over(of)})
    near, others = counted(near, "not own")
    links, n = counted(near.where("low <> to").select("gid", F.col("to").alias("u"), F.col("low").alias("v")), "true")
    step = near.where("nth = 1").select("gid", "v", "to", "own")
    if n:
        ends = both_ways(links).select("gid", F.col("u").alias("v")).distinct()
        then = _contracted(ends, links, most).select("gid", F.col("v").alias("to"), "component")
        step = step.join(then, ["gid", "to"], "left").select("gid", "v", F.coalesce("component", "to").alias("to"), "own")
    if not others:
        return step.select("gid", "v", F.col("to").alias("component"))
    # an edge's end that is no vertex gives no component its name
    step = cut(step.where("own"))
    return step.join(step.groupBy("gid", "to").agg(F.min("v").alias("component")), ["gid", "to"]).select("gid", "v", "component")


def _contracted(v: DataFrame, e: DataFrame, most: int) -> DataFrame:
    """Components of giant graphs.

    By contraction: each round every vertex goes over to its neighbour (or itself) of lowest random rank, and the edges
    between what is left are those of the next round; a fixed share of the vertices is expected to vanish each time, whatever the shape. In
    the end the rounds' tables are joined from the last, smallest one back to the first."""
    edges, n = counted(undirected_edges(e), "true")
    steps = []
    for k in range(most):
        if not n:
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("r"), F.col(c).alias("x"))  # noqa: B023, E731
        near = both_ways(edges).groupBy("gid", "u").agg(F.min(rank("v")).alias("near"))
        step = cut(near.select("gid", F.col("u").alias("v"), F.least("near", rank("u")).getField("x").alias("to")))
        left = edges
        for c in ("u", "v"):
            left = left.join(step.select("gid", F.col("v").alias(c), F.col("to").alias(f"to_{c}")), ["gid", c])
        edges, n = counted(undirected_edges(left.select("gid", F.col("to_u").alias("u"), F.col("to_v").alias("v"))), "true", edges)
        steps.append(step)
    else:
        raise RuntimeError(f"components are not settled after {most} rounds")
    label = None
    for step in reversed(steps):
        if label is None:
            label = step
        else:
            then = label.select("gid", F.col("v").alias("to"), F.col("to").alias("then"))
            label = step.join(then, ["gid", "to"], "left").select("gid", "v", F.coalesce("then", "to").alias("to"))
    out = v.select("gid", "v", F.col("v").alias("to")) if label is None else v.select("gid", "v").join(label, ["gid", "v"], "left").withColumn("to", F.coalesce("to", "v"))
    out = cut(out.select("gid", "v", "to"), *steps)
    low = out.groupBy("gid", "to").agg(F.min("v").alias("component"))
    return cut(out.join(low, ["gid", "to"]).select("gid", "v", "component"), out)


def component_cost(v: DataFrame, parts: DataFrame) -> DataFrame:
    return v.join(parts, ["gid", "v"]).groupBy("gid", "component").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))


def heaviest(costs: DataFrame) -> DataFrame:
    """The component of largest cost of each graph; ties: the lowest id."""
    return costs.groupBy("gid").agg(F.max_by("component", F.struct("cost", -F.col("component"))).alias("component"), F.max("cost").alias("cost"))


def normalize_cost(v: DataFrame) -> DataFrame:
    """Costs as shares of their graph's; unchanged where the sum is 0."""
    total = v.groupBy("gid").agg(F.sum("cost").alias("total_"))
    return v.join(total, "gid").withColumn("cost", F.when(F.col("total_") == 0, F.col("cost")).otherwise(F.col("cost") / F.col("total_"))).drop("total_")


def bfs(v: DataFrame, e: DataFrame, roots: DataFrame | None = None, most: int = 100_000, small: int = 20_000) -> DataFrame:
    """(gid, v, level, parent) from the roots (gid, v), else from each graph's lowest vertex; the parent is the lowest neighbour a level up.

    Graphs of up to `small` edges both ways are an array each. In larger ones a round finds a level; only the last one is joined."""
    start = roots if roots is not None else v.groupBy("gid").agg(F.min("v").alias("v"))
    if start.schema["v"].dataType != LongType():
        return _by_levels(cut(both_ways(e)), start, most)
    rows = cut(both_ways(e).select("gid", F.col("u").cast("long").alias("v"), F.col("v").cast("long").alias("to")).unionByName(start.select("gid", "v", F.lit(None).cast("long").alias("to"))))
    few, large = by_size(rows, small)
    few = _packed(few).withColumn("l_", F.arrow_udf(reached, "array<struct<v:bigint,level:int,parent:bigint>>")("g_")).select("gid", F.inline("l_"))
    few, deep = counted(few, F.col("level") >= most)
    if deep:
        raise RuntimeError(f"the graph has more than {most} levels")
    if large is None:
        return few
    wide = rows.join(large, "gid", "left_semi")
    return cut(few.unionByName(_by_levels(cut(wide.where("to is not null").select("gid", F.col("v").alias("u"), F.col("to").alias("v"))), wide.where("to is null").select("gid", "v"), most)))


def _by_levels(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """Breadth-first search in giant graphs, for edges both ways."""
    front = cut(start.select("gid", "v", F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent")))
    before, done = None, [front]
    for k in range(1, most + 1):
        near = edges.join(front.select("gid", F.col("v").alias("u")), ["gid", "u"]).groupBy("gid", "v").agg(F.min("u").alias("parent"))
        seen = front if before is None else front.select("gid", "v").unionByName(before.select("gid", "v"))  # neighbours are at most one level back
        new, n = counted(near.join(seen, ["gid", "v"], "left_anti").select("gid", "v", F.lit(k).alias("level"), "parent"), "true")
        if not n:
            break
        before, front = front, new
        done.append(new)
        if len(done) == 32:
            whole = done[0]
            for d in done[1:]:
                whole = whole.unionByName(d)
            done = [cut(whole)]
    else:
        raise RuntimeError(f"the graph has more than {most} levels")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return cut(out)


def level_profile(v: DataFrame, levels: DataFrame) -> DataFrame:
    """Cost and size of each level, and sums up to it."""
    p = v.join(levels, ["gid", "v"]).groupBy("gid", "level").agg(F.sum("cost").alias("cost"), F.count("*").alias("size"))
    w = Window.partitionBy("gid").orderBy("level")
    return p.withColumn("cost_to", F.sum("cost").over(w)).withColumn("size_to", F.sum("size").over(w))


def choose_levels(profile: DataFrame) -> DataFrame:
    """(gid, l1, l0, l2, k): l1 is the first level to pass half the cost; l0 the highest up to it and l2 the lowest behind it that are small enough. l2 may be one past the last level."""
    w = Window.partitionBy("gid")
    p = profile.withColumn("all_", F.sum("cost").over(w)).withColumn("n_", F.sum("size").over(w)).withColumn("last_", F.max("level").over(w))
    l1 = p.where(F.col("cost_to") * 2 > F.col("all_")).groupBy("gid").agg(F.min("level").alias("l1"), F.min_by("size_to", "level").alias("k"), F.first("n_").alias("n"), F.first("last_").alias("last"))
    q = profile.join(l1, "gid")
    a = q.where((F.col("level") <= F.col("l1")) & (F.col("size") + 2 * (F.col("l1") - F.col("level")) <= 2 * F.sqrt("k"))).groupBy("gid").agg(F.max("level").alias("l0"))
    b = q.where((F.col("level") > F.col("l1")) & (F.col("size") + 2 * (F.col("level") - F.col("l1") - 1) <= 2 * F.sqrt(F.col("n") - F.col("k")))).groupBy("gid").agg(F.min("level").alias("l2"))
    return l1.join(a, "gid", "left").join(b, "gid", "left").select("gid", "l1", "l0", F.coalesce("l2", F.col("last") + 1).alias("l2"), "k")


def subtree_cost(v: DataFrame, tree: DataFrame) -> DataFrame:
    """(gid, v, subtree, root): cost of each vertex and all below it, and its tree's top, for tree(gid, v, parent).

    Ancestors by doubling: each round adds what the vertices 2**k below hold, so rounds are the logarithm of the depth."""
    state = cut(tree.join(v.select("gid", "v", "cost"), ["gid", "v"]).select("gid", "v", F.col("parent").alias("up"), F.col("cost").alias("subtree"), F.coalesce("parent", "v").alias("root")))
    for _ in range(60):
        gives = state.where("up is not null").groupBy("gid", F.col("up").alias("v")).agg(F.sum("subtree").alias("more"))
        above = state.select("gid", F.col("v").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"))
        state, n = counted(state.join(gives, ["gid", "v"], "left").join(above, ["gid", "up"], "left").select("gid", "v", F.col("up2").alias("up"), (F.col("subtree") + F.coalesce("more", F.lit(0.0))).alias("subtree"), F.coalesce("root2", "root").alias("root")), "up is not null", state)
        if not n:
            return state.select("gid", "v", "subtree", "root")
    raise RuntimeError("the tree is too deep, or has a cycle")


def cycle_side_cost(path: DataFrame, tree: DataFrame, subtree: DataFrame, v: DataFrame) -> DataFrame:
    """Cost hanging off each cycle vertex: its subtree without itself and without its children on the cycle."""
    subtree = subtree.select("gid", F.col("v").alias("vertex"), "subtree")
    own = path.join(subtree, ["gid", "vertex"]).join(v.select("gid", F.col("v").alias("vertex"), "cost"), ["gid", "vertex"])
    kids = path.join(tree.select("gid", F.col("v").alias("vertex"), "parent"), ["gid", "vertex"]).where("parent is not null").join(subtree, ["gid", "vertex"])
    kids = kids.groupBy("gid", "pair", F.col("parent").alias("vertex")).agg(F.sum("subtree").alias("on_cycle"))
    out = own.join(kids, ["gid", "pair", "vertex"], "left")
    return out.select("gid", "pair", "vertex", (F.col("subtree") - F.col("cost") - F.coalesce("on_cycle", F.lit(0.0))).alias("hanging"))


def shrink(v: DataFrame, e: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges each graph's vertices of inside(gid, v) into their lowest one, of cost 0; every outside neighbour is linked once."""
    low = inside.groupBy("gid").agg(F.min("v").alias("into"))
    m = inside.select("gid", "v").distinct().join(low, "gid")
    ends = e
    for c in ("u", "v"):
        ends = ends.join(m.select("gid", F.col("v").alias(c), F.col("into").alias(f"to_{c}")), ["gid", c], "left").withColumn(c, F.coalesce(f"to_{c}", c)).drop(f"to_{c}")
    kept = v.join(m, ["gid", "v"], "left").where("into is null or into = v").select("gid", "v", F.when(F.col("into").isNotNull(), 0.0).otherwise(F.col("cost")).alias("cost"))
    return kept, undirected_edges(ends)


def pack_components(costs: DataFrame) -> DataFrame:
    """part of each component (gid, component, cost): A until it holds more than a third, the rest B; heavy ones first."""
    w = Window.partitionBy("gid").orderBy(F.desc("cost"), "component")
    total = F.sum("cost").over(Window.partitionBy("gid"))
    before = F.coalesce(F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return costs.withColumn("before_", before).withColumn("total_", total).withColumn("part", F.when(F.col("before_") * 3 <= F.col("total_"), "A").otherwise("B")).drop("before_", "total_")


def level_separator(levels: DataFrame, chosen: DataFrame) -> DataFrame:
    """C: the vertices on the levels l0 and l2."""
    return levels.join(chosen, "gid").where("level = l0 or level = l2").select("gid", "v")


def sides(v: DataFrame, e: DataFrame, c: DataFrame) -> DataFrame:
    """part of every vertex: C as given; what is left falls into components, packed into A and B."""
    rest = v.join(c, ["gid", "v"], "left_anti")
    _, live = live_subgraph(v, e, rest)
    parts = components(rest, live)
    packed = pack_components(component_cost(rest, parts)).select("gid", "component", "part")
    return parts.join(packed, ["gid", "component"]).select("gid", "v", "part").unionByName(c.select("gid", "v", F.lit("C").alias("part")))


def _arrays(v: DataFrame, e: DataFrame, half: DataFrame | None, small: int) -> tuple[DataFrame | None, tuple[DataFrame, ...] | None]:
    """(gid, g_), an array of (kind, a, b, x) for each graph of up to `small` rows (see divide.divider), and (v, e, half) of the others; None without any."""
    longs = [v.schema["v"], e.schema["u"], e.schema["v"], *([half.schema["tail"], half.schema["head"]] if half is not None else [])]
    if small <= 0 or any(f.dataType != LongType() for f in longs):
        return None, (v, e, half)
    none, number = F.lit(None), lambda k: F.lit(k).cast("tinyint").alias("kind")
    rows = v.select("gid", number(0), F.col("v").alias("a"), none.cast("long").alias("b"), F.col("cost").cast("double").alias("x"))
    rows = rows.unionByName(e.select("gid", number(1), F.col("u").alias("a"), F.col("v").alias("b"), none.cast("double").alias("x")))
    if half is not None:
        place = F.col("pos") if half.schema["pos"].dataType == DoubleType() else F.row_number().over(Window.partitionBy("gid", "tail").orderBy("pos", F.least("tail", "head"), F.greatest("tail", "head"))).cast("double")
        rows = rows.unionByName(half.select("gid", number(2), F.col("tail").alias("a"), F.col("head").alias("b"), place.alias("x")))
    rows = cut(rows)
    few, large = by_size(rows, small)
    few = few.groupBy("gid").agg(F.collect_list(F.struct("kind", "a", "b", "x")).alias("g_"))
    keep = lambda t: t.join(large, "gid", "left_semi")
    return few, None if large is None else (keep(v), keep(e), None if half is None else keep(half))


def find_separator(v: DataFrame, e: DataFrame, most: int = 60, half: DataFrame | None = None, small: int = 20_000) -> DataFrame:
    """(gid, v, part): no edge between A and B, and neither above two thirds of the cost.

    Graphs whose components are all light are packed without C. Otherwise two levels of a breadth-first search in
    the heaviest component go to C. What lies between them may still be too heavy:

    With half, an embedding (gid, tail, head, pos) of every edge both ways, pos growing clockwise, a cycle divides it (see
    darts.between_levels), and C has at most 2 sqrt(2 n) vertices in every graph.

    Without it the levels are cut again, until no part has over two thirds; one cut keeps C within 2 sqrt(2 n) vertices, a
    further one adds as much for the part it divides: see quality.check_balance.

    Graphs of up to `small` vertices, edges and half-edges are an array each and are divided where they are; larger ones by rounds of joins."""
    few, large = _arrays(v, e, half, small)
    if few is None:
        return _divided(v, e, most, half)
    few = few.select("gid", F.inline(F.arrow_udf(divider(half is not None, most), "array<struct<v:bigint,part:string>>")("g_")))
    return few if large is None else few.unionByName(_divided(*large[:2], most, large[2]))


def _divided(v: DataFrame, e: DataFrame, most: int, half: DataFrame | None) -> DataFrame:
    """Separators of giant graphs."""
    v, e = cut(normalize_cost(v)), cut(e)
    c = None
    for _ in range(most):
        rest = v if c is None else v.join(c, ["gid", "v"], "left_anti")
        _, live = live_subgraph(v, e, rest)
        parts = components(rest, live)
        top = heaviest(component_cost(rest, parts))
        heavy = cut(parts.join(top.where("cost * 3 > 2 + 1e-9").select("gid", "component"), ["gid", "component"]).select("gid", "v"))
        if heavy.isEmpty():
            return sides(v, e, c if c is not None else heavy)
        if half is not None and c is not None:
            raise RuntimeError("half is no embedding of the edges in the plane")
        hv, he = map(cut, live_subgraph(v, e, heavy))
        levels = bfs(hv, he)
        chosen = cut(choose_levels(level_profile(hv, levels)).withColumn("l0", F.coalesce("l0", "l1")))
        more = level_separator(levels, chosen)
        if half is not None:
            more = more.unionByName(between_levels(hv, levels, chosen, half)).distinct()
        c = cut(more if c is None else c.unionByName(more))
    raise RuntimeError(f"graphs are not divided after {most} rounds")


def iterated_separator(v: DataFrame, e: DataFrame, max_piece: int, most: int = 40, half: DataFrame | None = None, small: int = 20_000) -> DataFrame:
    """(gid, v, is_separator, piece_id): separates with unit costs again and again, all pieces that are too large in one go, until each has at most max_piece vertices. piece_id: its lowest vertex.

    half: an embedding of the edges, see find_separator; a piece has what it leaves of it. Graphs of up to `small` rows are an array each, for all rounds."""
    few, large = _arrays(v.withColumn("cost", F.lit(1.0)), e, half, small)
    if few is None:
        return _iterated(v, e, max_piece, most, half, small)
    few = few.select("gid", F.inline(F.arrow_udf(divider(half is not None, 60, max_piece, most), "array<struct<v:bigint,piece_id:bigint>>")("g_")))
    few = few.select("gid", "v", F.col("piece_id").isNull().alias("is_separator"), "piece_id")
    return few if large is None else few.unionByName(_iterated(*large[:2], max_piece, most, large[2], small))


def _iterated(v: DataFrame, e: DataFrame, max_piece: int, most: int, half: DataFrame | None, small_graph: int) -> DataFrame:
    """Pieces of giant graphs, a round of find_separator at a time; pieces that are small by then are divided in place."""
    todo = cut(v.select("gid", "v", F.lit(0).cast("long").alias("piece")))
    cuts: list[DataFrame] = []
    for _ in range(most):
        big = todo.groupBy("gid", "piece").agg(F.count("*").alias("n")).where(F.col("n") > max_piece)
        if big.isEmpty():
            break
        name = F.struct("gid", "piece")
        large = todo.join(big.select("gid", "piece"), ["gid", "piece"], "left_semi")
        small = todo.join(big.select("gid", "piece"), ["gid", "piece"], "left_anti")
        gv = large.select(name.alias("gid"), "v", F.lit(1.0).alias("cost"), F.col("gid").alias("g0"))
        ge = e.join(gv.select(F.col("g0").alias("gid"), F.col("v").alias("u"), F.col("gid").alias("name")), ["gid", "u"]).select(F.col("name").alias("gid"), "u", "v")
        ge = ge.join(gv.select("gid", "v"), ["gid", "v"], "left_semi").select("gid", "u", "v")
        name_of = gv.select(F.col("g0").alias("gid"), "v", F.col("gid").alias("name"))
        own = None
        if half is not None:
            own = half.join(name_of.withColumnRenamed("v", "tail"), ["gid", "tail"]).select(F.col("name").alias("gid"), "tail", "head", "pos")
            own = own.join(gv.select("gid", F.col("v").alias("head")), ["gid", "head"], "left_semi").select("gid", "tail", "head", "pos")
        parts = cut(find_separator(gv.drop("g0"), ge, half=own, small=small_graph))
        cuts.append(cut(parts.where("part = 'C'").select("gid.gid", "v")))
        rest = parts.where("part <> 'C'").withColumn("n_", F.min("v").over(Window.partitionBy("gid", "part")))
        todo = cut(small.unionByName(rest.select("gid.gid", "v", F.col("n_").alias("piece"))))
    else:
        raise RuntimeError(f"pieces are too large after {most} rounds")
    out = todo.select("gid", "v", F.lit(False).alias("is_separator"), F.min("v").over(Window.partitionBy("gid", "piece")).alias("piece_id"))
    for c in cuts:
        out = out.unionByName(c.select("gid", "v", F.lit(True).alias("is_separator"), F.lit(None).cast("long").alias("piece_id")))
    return out
