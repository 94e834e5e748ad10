"""Region tables: arcs(map_id, arc_id, region_id, first_edge, last_edge, first_side, last_side, edge_count), chords(map_id, chord_id, region_a, region_b, left_edge, right_edge, y, is_null_length) and regions(map_id, region_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.packed import COARSE, coarser
from ..plans.iterate import counted, cut
from ..plans.ordered import ranks, running
from .chains import holding
from .graphs import components
from .nesting import innermost
from .walks import faces


def _lo(a: str = "left_edge", b: str = "right_edge") -> Column:
    return F.least(a, b)


def _hi(a: str = "left_edge", b: str = "right_edge") -> Column:
    return F.greatest(a, b)


def region_weight(regions: DataFrame, arcs: DataFrame) -> DataFrame:
    """weight: the largest edge_count of a region's arcs, 0 without arcs."""
    w = arcs.groupBy("map_id", "region_id").agg(F.max("edge_count").alias("weight"))
    return regions.select("map_id", "region_id").join(w, ["map_id", "region_id"], "left").na.fill(0, ["weight"])


def region_degree(regions: DataFrame, chords: DataFrame) -> DataFrame:
    """degree: chords at each region."""
    d = chords.select("map_id", F.explode(F.array_distinct(F.array("region_a", "region_b"))).alias("region_id")).groupBy("map_id", "region_id").agg(F.count("*").alias("degree"))
    return regions.select("map_id", "region_id").join(d, ["map_id", "region_id"], "left").na.fill(0, ["degree"])


def map_flags(regions: DataFrame, arcs: DataFrame, chords: DataFrame, gamma: int) -> DataFrame:
    """Per map: max_degree, is_conformal (degrees of at most 4), is_semigranular (weights of at most gamma), empty regions."""
    both = region_weight(regions, arcs).join(region_degree(regions, chords), ["map_id", "region_id"])
    return both.groupBy("map_id").agg(F.max("degree").alias("max_degree"), F.bool_and(F.col("degree") <= 4).alias("is_conformal"), F.bool_and(F.col("weight") <= gamma).alias("is_semigranular"), F.count(F.when(F.col("weight") == 0, 1)).alias("empty_regions"))


def arc_flags(arcs: DataFrame) -> DataFrame:
    """is_null (no edges), is_single (one edge), is_virtual (no first edge)."""
    return arcs.withColumn("is_null", F.col("edge_count") == 0).withColumn("is_single", (F.col("edge_count") == 1) & (F.col("first_edge") == F.col("last_edge"))).withColumn("is_virtual", F.col("first_edge").isNull())


def _ends(chords: DataFrame, *keep: str) -> DataFrame:
    """A row for each end of a chord: map_id, the kept columns, edge, y."""
    return chords.select("map_id", *keep, "y", F.explode(F.array_distinct(F.array("left_edge", "right_edge"))).alias("edge"))


def _no_vertex(ends: DataFrame, heights: DataFrame | None) -> DataFrame:
    """Without the ends that are vertices: those at the height of an end of their edge, for heights(map_id, edge, y), two rows an edge."""
    return ends if heights is None else ends.join(heights.select("map_id", "edge", "y"), ["map_id", "edge", "y"], "left_anti")


def contract_chords(regions: DataFrame, arcs: DataFrame, chords: DataFrame, drop: DataFrame, matched: bool = False, heights: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Takes the chords of drop(map_id, chord_id) out (matched: no two of them share a region): joined regions get the lowest id; arcs and the other chords move.

    An end of a dropped chord vanishes if it is no vertex (see heights; without them no end is one) and no
    other chord of the joined region has an end on that edge. Neighbouring arcs of a side that meet on the edge of
    a vanished end become one: that with the lowest id, the edge counts summed."""
    out = chords.join(drop, ["map_id", "chord_id"], "left_semi")
    v = regions.select(F.col("map_id").alias("gid"), F.col("region_id").alias("v"))
    if matched:
        pairs = out.select(F.col("map_id").alias("gid"), F.greatest("region_a", "region_b").alias("v"), F.least("region_a", "region_b").alias("to"))
        label = v.join(pairs, ["gid", "v"], "left").select(F.col("gid").alias("map_id"), F.col("v").alias("region_id"), F.coalesce("to", "v").alias("component"))
    else:
        label = components(v, out.select(F.col("map_id").alias("gid"), F.col("region_a").alias("u"), F.col("region_b").alias("v"))).select(F.col("gid").alias("map_id"), F.col("v").alias("region_id"), "component")

    def renamed(c: DataFrame) -> DataFrame:
        for side in ("region_a", "region_b"):
            c = c.join(label.select("map_id", F.col("region_id").alias(side), F.col("component").alias(f"{side}_")), ["map_id", side]).withColumn(side, F.col(f"{side}_")).drop(f"{side}_")
        return c.select(*chords.columns)

    kept = renamed(chords.join(drop, ["map_id", "chord_id"], "left_anti"))
    used = _ends(kept.select("map_id", F.explode(F.array("region_a", "region_b")).alias("region_id"), "left_edge", "right_edge", "y"), "region_id").select("map_id", "region_id", "edge")
    gone = _no_vertex(_ends(renamed(out), "region_a").withColumnRenamed("region_a", "region_id"), heights).select("map_id", "region_id", "edge")
    gone = gone.join(used, ["map_id", "region_id", "edge"], "left_anti").distinct().withColumn("gone_", F.lit(True))
    moved = arcs.join(label, ["map_id", "region_id"]).drop("region_id").withColumnRenamed("component", "region_id").withColumn("lo_", F.least("first_edge", "last_edge")).withColumn("hi_", F.greatest("first_edge", "last_edge"))
    moved = moved.join(gone.withColumnRenamed("edge", "lo_"), ["map_id", "region_id", "lo_"], "left")
    w = Window.partitionBy("map_id", "region_id", "first_side").orderBy("lo_", "arc_id")
    before = F.lag("hi_").over(w)
    new = F.when(F.col("gone_") & ((before == F.col("lo_")) | (before + 1 == F.col("lo_"))), 0).otherwise(1)
    run = moved.withColumn("new_", new).withColumn("run_", F.sum("new_").over(w))
    first, last = F.struct("lo_", "arc_id"), F.struct("hi_", "arc_id")
    glued = run.groupBy("map_id", "region_id", "first_side", "run_").agg(F.min("arc_id").alias("arc_id"), F.min_by("first_edge", first).alias("first_edge"), F.max_by("last_edge", last).alias("last_edge"), F.max_by("last_side", last).alias("last_side"), F.sum("edge_count").alias("edge_count")).drop("run_")
    alive = label.select("map_id", F.col("component").alias("region_id")).distinct()
    return region_weight(alive, glued), glued, kept


def merged_weights(regions: DataFrame, arcs: DataFrame, chords: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """(map_id, chord_id, region_a, region_b, da, db, merged) for each chord between two regions: their degrees, and the largest edge count that an arc would have without the chord.

    Arcs of both regions that touch an end which would vanish count together; those that touch both ends, be it without edges, join both sums."""
    s = region_degree(regions, chords).join(region_weight(regions, arcs), ["map_id", "region_id"])
    c = chords.where("region_a <> region_b")
    for side in ("a", "b"):
        c = c.join(s.select("map_id", F.col("region_id").alias(f"region_{side}"), F.col("degree").alias(f"d{side}"), F.col("weight").alias(f"w{side}")), ["map_id", f"region_{side}"])
    both = F.explode(F.array("region_a", "region_b")).alias("region_id")
    uses = _ends(chords.select("map_id", "chord_id", both, "left_edge", "right_edge", "y"), "chord_id", "region_id").select("map_id", "region_id", "edge", F.col("chord_id").alias("other"))
    ends = _no_vertex(_ends(c.select("map_id", "chord_id", both, "left_edge", "right_edge", "y"), "chord_id", "region_id"), heights)
    held = ends.join(uses, ["map_id", "region_id", "edge"]).where("other <> chord_id").select("map_id", "chord_id", "edge").distinct()
    free = ends.join(held, ["map_id", "chord_id", "edge"], "left_anti")
    lo, hi = F.least("first_edge", "last_edge"), F.greatest("first_edge", "last_edge")
    touch = arcs.where("first_edge is not null").select("map_id", "region_id", "arc_id", "edge_count", F.explode(F.array_distinct(F.array(lo, hi, hi + 1))).alias("edge"))
    met = free.join(touch, ["map_id", "region_id", "edge"]).groupBy("map_id", "chord_id", "arc_id").agg(F.first("edge_count").alias("n"), F.min("edge").alias("e0"), F.max("edge").alias("e1"))
    met = met.join(c.select("map_id", "chord_id", F.least("left_edge", "right_edge").alias("a_")), ["map_id", "chord_id"])
    part = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0))
    one = met.groupBy("map_id", "chord_id").agg(part((F.col("e0") == F.col("a_")) & (F.col("e1") == F.col("a_"))).alias("low"), part(F.col("e0") > F.col("a_")).alias("high"), part(F.col("e0") < F.col("e1")).alias("bridge"), F.bool_or(F.col("e0") < F.col("e1")).alias("bridged"))
    sums = F.when(F.col("bridged"), F.col("low") + F.col("high") + F.col("bridge")).otherwise(F.greatest("low", "high"))
    got = c.join(one.select("map_id", "chord_id", sums.alias("sums")), ["map_id", "chord_id"], "left")
    return got.select("map_id", "chord_id", "region_a", "region_b", "da", "db", F.greatest("wa", "wb", F.coalesce("sums", F.lit(0))).alias("merged"))


GLUED = ("map_id", "region_id", "first_side", "arc_id", "first_edge", "last_edge", "last_side", "edge_count")


def coarsen(regions: DataFrame, arcs: DataFrame, chords: DataFrame, gamma: int, most: int = 200, heights: DataFrame | None = None, below: int | None = None, small: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drops chords as long as one has a side of degree below 3 and a merged weight of at most gamma (see merged_weights); below: only chords with an id below it. In a round those go that rank first by a hash of the round at both their regions, a fixed share of the candidates on average.

    Maps of up to `small` rows are an array each and take all their rounds where they are; larger ones, and those with nulls elsewhere than in arcs without edges, are joined in rounds. Same rows either way."""
    if small <= 0 or any(t.schema[c].dataType != LongType() for t, c in ((regions, "map_id"), (regions, "region_id"), (chords, "chord_id"))):
        return _coarsen_joined(regions, arcs, chords, gamma, most, heights, below)
    empty = lambda *names: F.array_contains(F.array(*[F.col(c).isNull() for c in names]), True)
    odd = [regions.select("map_id", empty("region_id").alias("odd")), arcs.select("map_id", (empty("region_id", "arc_id", "edge_count") | (F.col("first_edge").isNull() != F.col("last_edge").isNull())).alias("odd")), chords.select("map_id", empty("chord_id", "region_a", "region_b", "left_edge", "right_edge").alias("odd"))]
    large = cut(odd[0].unionByName(odd[1]).unionByName(odd[2]).groupBy("map_id").agg(F.count("*").alias("n"), F.bool_or("odd").alias("odd")).where((F.col("n") > small) | F.col("odd")).select("map_id"))
    whole = [regions, arcs, chords]
    some = not large.isEmpty()
    r, a, c = [t.join(large, "map_id", "left_anti") for t in whole] if some else whole
    c = c.withColumns({"lo_": _lo(), "hi_": _hi(), "lo_fixed": F.lit(False), "hi_fixed": F.lit(False)})
    if heights is not None:
        for end in ("lo", "hi"):
            known = heights.select("map_id", F.col("edge").alias(f"{end}_"), "y", F.lit(True).alias("known_")).distinct()
            c = c.join(known, ["map_id", f"{end}_", "y"], "left").withColumn(f"{end}_fixed", F.col("known_").isNotNull()).drop("known_")
    long = lambda x, name: F.col(x).cast("long").alias(name)
    rs = r.groupBy("map_id").agg(F.collect_list("region_id").alias("r_"))
    as_ = a.groupBy("map_id").agg(F.collect_list(F.struct(*[long(x, x) for x in ("arc_id", "region_id", "first_edge", "last_edge")], "first_side", "last_side", long("edge_count", "edge_count"))).alias("a_"))
    own = [x for x in chords.columns if x != "map_id"]
    asked = F.struct("chord_id", long("region_a", "region_a"), long("region_b", "region_b"), long("lo_", "lo"), long("hi_", "hi"), "lo_fixed", "hi_fixed")
    cs = c.groupBy("map_id").agg(F.collect_list(F.struct(*own, asked.alias("asked_"))).alias("c_"))
    packed = rs.join(as_, "map_id", "left").join(cs, "map_id", "left")
    none = lambda t, x: F.coalesce(x, F.array().cast(t.schema[x].dataType))
    packed = packed.select("map_id", "r_", none(as_, "a_").alias("a_"), none(cs, "c_").alias("c_"))
    packed = packed.withColumn("z_", F.arrow_udf(coarser(gamma, below, most), COARSE)("map_id", "r_", "a_", "c_.asked_"))
    kept = F.transform("z_.chords", lambda x: F.struct(*[x[y].alias(y) if y in ("region_a", "region_b") else F.get("c_", x["at"])[y].alias(y) for y in own]))
    out = cut(packed.select("map_id", F.col("z_.regions").alias("r_"), F.col("z_.arcs").alias("a_"), kept.alias("c_")))
    a = out.select("map_id", F.inline("a_")).select(*GLUED)
    r = region_weight(out.select("map_id", F.explode("r_").alias("region_id")), a)
    c = out.select("map_id", F.inline("c_")).select(*chords.columns)
    if not some:
        return r, a, c
    r2, a2, c2 = _coarsen_joined(*[t.join(large, "map_id", "left_semi") for t in whole], gamma, most, heights, below)
    return r.unionByName(region_weight(r2, a2)), a.unionByName(a2.select(*GLUED)), c.unionByName(c2)


def _coarsen_joined(regions: DataFrame, arcs: DataFrame, chords: DataFrame, gamma: int, most: int, heights: DataFrame | None, below: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """coarsen for giant maps: a round of joins at a time."""
    for k in range(most):
        c = merged_weights(regions, arcs, chords, heights).where((F.least("da", "db") < 3) & (F.col("merged") <= gamma))
        c = c if below is None else c.where(F.col("chord_id") < below)
        rank = F.struct(F.xxhash64("map_id", "chord_id", F.lit(k)), "chord_id")
        first = c.select("map_id", "chord_id", F.explode(F.array("region_a", "region_b")).alias("region_id")).groupBy("map_id", "region_id").agg(F.min_by("chord_id", rank).alias("chord_id"))
        chosen = cut(first.groupBy("map_id", "chord_id").agg(F.count("*").alias("n")).where("n = 2").select("map_id", "chord_id"))
        if chosen.isEmpty():
            return regions, arcs, chords
        regions, arcs, chords = map(cut, contract_chords(regions, arcs, chords, chosen, matched=True, heights=heights))
    raise RuntimeError(f"chords can still go after {most} rounds")


def split_ranges(ranges: DataFrame, cuts: DataFrame) -> DataFrame:
    """Ranges (map_id, range_id, s, e), both ends included, cut behind each edge of cuts(map_id, edge) inside them.

    With first_side, last_side and turn, the vertex where the range goes over to its other side (null: nowhere): edges before it are on first_side,
    from it on on last_side, and each piece has the sides of its own first and last edge. A range of two sides without a turn keeps first_side
    up to its first cut, and last_side behind."""
    inner = holding(cuts.select("map_id", "edge").distinct(), ranges.select("map_id", "range_id", "s", "e"), ["map_id"], F.col("edge"), F.col("s"), F.col("e") - 1).select("map_id", "range_id", F.col("edge").alias("end"))
    ends = inner.unionByName(ranges.select("map_id", "range_id", F.col("e").alias("end")))
    prev = F.lag("end").over(Window.partitionBy("map_id", "range_id").orderBy("end"))
    own = [c for c in ("first_side", "last_side", "turn") if c in ranges.columns]
    out = ends.withColumn("prev", prev).join(ranges.select("map_id", "range_id", "s", *own), ["map_id", "range_id"]).withColumn("b", F.coalesce(F.col("prev") + 1, F.col("s")))
    if not own:
        return out.select("map_id", "range_id", F.col("b").alias("s"), F.col("end").alias("e"))
    side = lambda edge: F.when(F.coalesce(edge < F.col("turn"), F.col("prev").isNull()), F.col("first_side")).otherwise(F.col("last_side"))
    return out.select("map_id", "range_id", F.col("b").alias("s"), F.col("end").alias("e"), side(F.col("b")).alias("first_side"), side(F.col("end")).alias("last_side"))


def assign_arcs(arcs: DataFrame, chords: DataFrame, ranged: bool = False) -> DataFrame:
    """region of arcs (map_id, arc_id, key): the number of chords (map_id, key) with a key up to theirs; one running sum, no range join. ranged: for giant maps, see plans.ordered."""
    a = arcs.select("map_id", "key", F.lit(0).cast("long").alias("one"), "arc_id")
    c = chords.select("map_id", "key", F.lit(1).cast("long").alias("one"), F.lit(None).cast("long").alias("arc_id"))
    both = a.unionByName(c)
    if ranged:
        both = running(both, ["map_id"], [F.col("key"), F.col("one").desc()], {"region": F.col("one")})
    else:
        w = Window.partitionBy("map_id").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("region", F.sum("one").over(w))
    return both.where("one = 0").select("map_id", "arc_id", "region")


def at_height(hits: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Without the arcs that hold the edge e, but not the height y: arcs on one edge span y_first to y_last; those of more edges reach, on their
    first or last one, from there to the next vertex, by ends(map_id, edge, y_start, y_end). A null y, and an arc without heights, hold all of the edge."""
    one = F.col("lo") == F.col("hi")
    span = lambda a, b: F.col("y").between(F.least(a, b), F.greatest(a, b))
    low_y, high_y = F.when(F.col("first_edge") <= F.col("last_edge"), F.col("y_first")).otherwise(F.col("y_last")), F.when(F.col("first_edge") <= F.col("last_edge"), F.col("y_last")).otherwise(F.col("y_first"))
    inside = F.when(one, span("y_first", "y_last"))
    if ends is not None:
        hits = hits.join(ends.select("map_id", F.col("edge").alias("e"), "y_start", "y_end"), ["map_id", "e"], "left")
        inside = inside.when(F.col("e") == F.col("lo"), span(low_y, F.col("y_end"))).when(F.col("e") == F.col("hi"), span(F.col("y_start"), high_y))
    return hits.where(F.coalesce(inside, F.lit(True)))


def locate_on_arcs(queries: DataFrame, arcs: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """For queries (map_id, query_id, e): arcs whose range holds e; per region those with e inside are preferred to those with e at an end, then the lowest id.

    With y in queries, and y_first and y_last in arcs (heights of their ends), arcs that lie elsewhere on the edge don't count; see at_height."""
    lo, hi = F.least("first_edge", "last_edge"), F.greatest("first_edge", "last_edge")
    placed = "y" in queries.columns and "y_first" in arcs.columns
    more = ["first_edge", "last_edge", "y_first", "y_last"] if placed else []
    hit = holding(queries, arcs.select("map_id", "arc_id", "region_id", lo.alias("lo"), hi.alias("hi"), *more), ["map_id"], F.col("e"), F.col("lo"), F.col("hi"))
    if placed:
        hit = at_height(hit, ends)
    inner = (F.col("lo") < F.col("e")) & (F.col("e") < F.col("hi"))
    return hit.groupBy("map_id", "query_id", "region_id").agg(F.min_by("arc_id", F.struct((~inner).alias("x"), F.col("arc_id").alias("i"))).alias("arc_id"))


def canonical_arcs(arcs: DataFrame, ranged: bool = False) -> DataFrame:
    """place: left side upwards, then right side downwards by the lowest edge; arcs without edges are left out; is_start and is_end. ranged: for giant maps, see plans.ordered."""
    key = F.least("first_edge", "last_edge")
    a = arcs.where("first_edge is not null").withColumn("key_", F.when(F.col("first_side") == "L", key).otherwise(-key))
    bounds = a.groupBy("map_id").agg(F.min(key).alias("lo_"), F.max(F.greatest("first_edge", "last_edge")).alias("hi_"))
    order = [F.col(c) for c in ("first_side", "key_", "arc_id")]
    a = ranks(a, ["map_id"], order, "place") if ranged else a.withColumn("place", F.row_number().over(Window.partitionBy("map_id").orderBy(*order)))
    return a.join(bounds, "map_id").select(*arcs.columns, (F.col("place") - 1).alias("place"), (key == F.col("lo_")).alias("is_start"), (F.greatest("first_edge", "last_edge") == F.col("hi_")).alias("is_end"))


def canonical_chords(chords: DataFrame, ranged: bool = False) -> DataFrame:
    """place by lower edge, higher edge, y and id. ranged: for giant maps, see plans.ordered."""
    order = [_lo(), _hi(), F.col("y"), F.col("chord_id")]
    c = ranks(chords, ["map_id"], order, "place") if ranged else chords.withColumn("place", F.row_number().over(Window.partitionBy("map_id").orderBy(*order)))
    return c.withColumn("place", F.col("place") - 1)


def chord_adjacent_arcs(chords: DataFrame, arcs: DataFrame) -> DataFrame:
    """Up to 4 arcs of a chord's regions that cover or border one of its ends, lowest ids first."""
    sides = F.explode(F.array_distinct(F.array("region_a", "region_b"))).alias("region_id")
    ends = chords.select("map_id", "chord_id", sides, F.array_distinct(F.array(_lo(), _hi())).alias("at")).select("map_id", "chord_id", "region_id", F.explode("at").alias("at")).distinct()
    near = holding(ends, arcs.select("map_id", "region_id", "arc_id", (F.least("first_edge", "last_edge") - 1).alias("lo"), (F.greatest("first_edge", "last_edge") + 1).alias("hi")), ["map_id", "region_id"], F.col("at"), F.col("lo"), F.col("hi"))
    nth = F.row_number().over(Window.partitionBy("map_id", "chord_id").orderBy("arc_id"))
    near = near.select("map_id", "chord_id", "arc_id").distinct()
    return near.withColumn("nth", nth).where("nth <= 4").groupBy("map_id", "chord_id").agg(F.sort_array(F.collect_list("arc_id")).alias("arcs"))


def merge_chord_sets(*sets: DataFrame) -> DataFrame:
    """Union by (lower edge, higher edge, y); chords from an edge to itself only if of no length."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    out = out.where("left_edge <> right_edge or is_null_length").select("map_id", _lo().alias("lo"), _hi().alias("hi"), "y", "is_null_length")
    return out.groupBy("map_id", "lo", "hi", "y").agg(F.bool_or("is_null_length").alias("is_null_length"))


def region_adjacency(chords: DataFrame, arcs: DataFrame) -> DataFrame:
    """Pairs of regions that share a chord, or both have an arc at a chord's end or the edge before it."""
    pairs = chords.where("region_a <> region_b").select("map_id", F.least("region_a", "region_b").alias("r1"), F.greatest("region_a", "region_b").alias("r2"))
    at = chords.select("map_id", F.explode(F.array(F.col("left_edge"), F.col("left_edge") - 1, F.col("right_edge"), F.col("right_edge") - 1)).alias("e")).distinct()
    hit = locate_on_arcs(at.withColumn("query_id", F.col("e")), arcs).select("map_id", "query_id", "region_id").distinct()
    two = hit.select("map_id", "query_id", F.col("region_id").alias("r1")).join(hit.select("map_id", "query_id", F.col("region_id").alias("r2")), ["map_id", "query_id"]).where("r1 < r2").select("map_id", "r1", "r2")
    return pairs.unionByName(two).distinct()


def split_regions(arcs: DataFrame, chords: DataFrame) -> DataFrame:
    """The innermost chord range that holds each arc (null: none); chord ranges are nested. (map_id, arc_id, chord_id)"""
    a = arcs.select("map_id", "arc_id", F.least("first_edge", "last_edge").alias("a"), F.greatest("first_edge", "last_edge").alias("z"))
    inside = holding(a, chords.select("map_id", "chord_id", _lo().alias("lo"), _hi().alias("hi")), ["map_id"], F.col("a"), F.col("lo"), F.col("hi")).where("z <= hi")
    inner = inside.groupBy("map_id", "arc_id").agg(F.min_by("chord_id", F.struct((F.col("hi") - F.col("lo")).alias("d"), F.col("chord_id").alias("i"))).alias("chord_id"))
    return a.select("map_id", "arc_id").join(inner, ["map_id", "arc_id"], "left")


def put_chords(regions: DataFrame, arcs: DataFrame, chords: DataFrame, new: DataFrame, small: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions with weight, arcs, chords) after new chords are put in: new(map_id, chord_id, region_id, left_edge, right_edge, y, is_null_length), each inside one region and with an id that no chord of the map has.

    A new chord cuts off what its edge range holds: that is a region of its own, with the map's next ids in order of the new chords' ids. An arc, or an old
    chord at the region, goes to the innermost new range that holds all of its edges, else stays; a new chord joins its own region and that around
    it. New ranges in one region are nested or apart (see nesting.innermost). Ends are edges, or places along them: columns lo and hi, of any type that can be sorted, in all three tables.

    If no map has more than `small` new chords, and no region more than that many arcs and chords, all order is by windows; else giant ones are sorted in ranges."""
    def placed(t: DataFrame, a: str, b: str) -> DataFrame:
        return t if "lo" in t.columns else t.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b) + 1})  # up to where the last edge ends

    base = regions.groupBy("map_id").agg(F.max("region_id").alias("base"))
    giant = not new.groupBy("map_id").agg(F.count("*").alias("n_")).where(F.col("n_") > small).isEmpty()
    nth = F.row_number().over(Window.partitionBy("map_id").orderBy("chord_id")).cast("long")
    put = placed(new, "left_edge", "right_edge")
    put = ranks(put, ["map_id"], [F.col("chord_id")], "nth") if giant else put.withColumn("nth", nth)
    own = cut(put.join(base, "map_id").withColumn("own", F.col("base") + F.col("nth")).drop("base", "nth"))
    a, c = placed(arcs, "first_edge", "last_edge"), placed(chords, "left_edge", "right_edge")
    ask = lambda kind, i: F.struct(F.lit(kind).alias("kind"), F.col(i).alias("id"))
    asked = a.select("map_id", "region_id", ask(0, "arc_id").alias("ask_id"), "lo", "hi")
    for kind, side in ((1, "region_a"), (2, "region_b")):
        asked = asked.unionByName(c.select("map_id", F.col(side).alias("region_id"), ask(kind, "chord_id").alias("ask_id"), "lo", "hi"))
    ranges = own.select("map_id", "region_id", F.col("own").alias("range_id"), "lo", "hi")
    outer, inner = innermost(ranges, asked, ["map_id", "region_id"], small)
    moved = cut(inner.select("map_id", "ask_id.kind", "ask_id.id", F.coalesce("range_id", "region_id").alias("to")))
    to = lambda kind, i, name: moved.where(F.col("kind") == kind).select("map_id", F.col("id").alias(i), F.col("to").alias(name))
    arcs_out = arcs.drop("region_id").join(to(0, "arc_id", "region_id"), ["map_id", "arc_id"]).select(*arcs.columns)
    old = chords.drop("region_a", "region_b").join(to(1, "chord_id", "region_a"), ["map_id", "chord_id"]).join(to(2, "chord_id", "region_b"), ["map_id", "chord_id"]).select(*chords.columns)
    fresh = own.join(outer.select("map_id", F.col("range_id").alias("own"), "outer"), ["map_id", "own"])
    fresh = fresh.withColumns({"region_a": F.coalesce("outer", "region_id"), "region_b": F.col("own")}).select(*chords.columns)
    every = cut(regions.select("map_id", "region_id").unionByName(own.select("map_id", F.col("own").alias("region_id"))))
    return region_weight(every, arcs_out), arcs_out, old.unionByName(fresh)


def internal_chords(region_arcs: DataFrame, chords: DataFrame) -> DataFrame:
    """Chords with both ends on arcs of one region (map_id, region_id, first_edge, last_edge); of those with the same lowest edge the first id."""
    a = region_arcs.select("map_id", "region_id", F.least("first_edge", "last_edge").alias("a"), F.greatest("first_edge", "last_edge").alias("z"))
    c = chords.select("map_id", "chord_id", _lo().alias("lo"), _hi().alias("hi"))
    one = holding(c, a, ["map_id"], F.col("lo"), F.col("a"), F.col("z")).select("map_id", "region_id", "chord_id", "lo", "hi").distinct()
    one = cut(one)  # read twice
    both = holding(one, a, ["map_id", "region_id"], F.col("hi"), F.col("a"), F.col("z")).select("map_id", "region_id", "chord_id", "lo").distinct()
    nth = F.row_number().over(Window.partitionBy("map_id", "region_id", "lo").orderBy("chord_id"))
    return both.withColumn("nth", nth).where("nth = 1").select("map_id", "region_id", "chord_id")


def region_boundary(arcs: DataFrame, chords: DataFrame) -> DataFrame:
    """Arcs and chords of each region in order of their lowest edge, chords first."""
    a = arcs.select("map_id", "region_id", F.least("first_edge", "last_edge").alias("key"), F.lit(1).alias("kind"), F.col("arc_id").alias("id"))
    c = chords.select("map_id", F.explode(F.array_distinct(F.array("region_a", "region_b"))).alias("region_id"), _lo().alias("key"), F.lit(0).alias("kind"), F.col("chord_id").alias("id"))
    w = Window.partitionBy("map_id", "region_id").orderBy("key", "kind", "id")
    return a.unionByName(c).withColumn("place", F.row_number().over(w) - 1)


def tree_order(tree: DataFrame) -> DataFrame:
    """(gid, v, parent, root, pre, last) for trees (gid, v, parent): what hangs on a vertex has pre from its own up to last. Children in order of their ids, by a walk around each tree."""
    kids = Window.partitionBy("gid", "parent").orderBy("v")
    t = cut(tree.select("gid", "v", "parent", F.when(F.col("parent").isNotNull(), F.lead("v").over(kids)).alias("sibling")))
    child = t.where("parent is not null").groupBy("gid", F.col("parent").alias("v")).agg(F.min("v").alias("child"))
    step = lambda back, x: F.struct(F.lit(back).alias("back"), F.col(x).alias("x"))
    t = cut(t.join(child, ["gid", "v"], "left"), t)
    down = t.select("gid", step(0, "v").alias("h"), F.when(F.col("child").isNotNull(), step(0, "child")).otherwise(step(1, "v")).alias("next"))
    back = t.select("gid", step(1, "v").alias("h"), F.when(F.col("sibling").isNotNull(), step(0, "sibling")).when(F.col("parent").isNotNull(), step(1, "parent")).otherwise(step(0, "v")).alias("next"))
    walk = cut(faces(down.unionByName(back)))
    zero = walk.join(t.where("parent is null").select("gid", step(0, "v").alias("h"), F.col("v").alias("root")), ["gid", "h"]).select("gid", "face", "root", F.col("pos").alias("zero"))
    place = walk.join(zero, ["gid", "face"]).withColumn("at", F.pmod(F.col("pos") - F.col("zero"), F.col("size")))
    both = place.groupBy("gid", F.col("h.x").alias("v"), "root").agg(F.min("at").alias("pre"), F.max("at").alias("last"))
    return t.select("gid", "v", "parent").join(both, ["gid", "v"])


def center_tree(tree: DataFrame, most: int = 60) -> DataFrame:
    """Splits rooted trees (gid, v, parent) again and again at the edge that leaves the smallest larger side, all parts in one go, until parts are single vertices.

    Returns an edge for each split: (gid, v, parent, part, depth, size, larger); part is the root of what was split. A cut edge's lower end is the root
    of the new part, so no part is rooted anew. Ties: the lowest vertex. What hangs on each vertex is counted once; a cut takes its own count from the
    vertices above it in its part, and parts of one vertex leave the rounds."""
    size = ((F.col("last") - F.col("pre") + 1) / 2).cast("long")
    whole = cut(tree_order(tree).select("gid", "v", "parent", "pre", "last", F.col("root").alias("part"), size.alias("n")))
    done = None
    for depth in range(most):
        total = whole.where("v = part").select("gid", "part", F.col("n").alias("size"))
        e = whole.where("v <> part").join(total, ["gid", "part"]).withColumn("larger", F.greatest("n", F.col("size") - F.col("n")))
        best, n = counted(e.groupBy("gid", "part").agg(F.min_by(F.struct("v", "parent", "size", "larger", "pre", "last", "n"), F.struct("larger", "v")).alias("b")).select("gid", "part", "b.*"), "true")
        if not n:
            return best.select("gid", "v", "parent", "part", F.lit(0).alias("depth"), "size", "larger") if done is None else done
        split = best.select("gid", "v", "parent", "part", F.lit(depth).alias("depth"), "size", "larger")
        done = cut(split) if done is None else cut(done.unionByName(split), done)
        gone = best.select("gid", "part", F.col("v").alias("cut_v"), F.col("pre").alias("cut_pre"), F.col("last").alias("cut_last"), F.col("n").alias("cut_n"))
        inside, above = F.col("pre").between(F.col("cut_pre"), F.col("cut_last")), (F.col("pre") < F.col("cut_pre")) & (F.col("last") > F.col("cut_last"))
        whole = cut(whole.join(gone, ["gid", "part"]).select("gid", "v", "parent", "pre", "last", F.when(inside, F.col("cut_v")).otherwise(F.col("part")).alias("part"), (F.col("n") - F.when(above, F.col("cut_n")).otherwise(0)).alias("n")), whole)
    raise RuntimeError(f"parts are left after {most} rounds")


def decomposition_tree(tree: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """td(gid, node, v, cut_parent, region, parent, depth): center_tree's splits as a binary tree, whose inner nodes are cut edges (v, cut_parent) and whose leaves are single regions.

    An edge is known by its lower end v: its node is 2 v, the leaf of region r is 2 r + 1. The node above a split is the split a level up
    that made its part; above a leaf it is the last split at the region."""
    splits = (cut(center_tree(tree)) if splits is None else splits).withColumnRenamed("parent", "cut_parent")
    none = F.lit(None).cast("long")
    made = splits.select("gid", F.explode(F.array("part", "v")).alias("part"), (F.col("depth") + 1).alias("depth"), (F.col("v") * 2).alias("parent"))
    inner = splits.join(made, ["gid", "part", "depth"], "left").select("gid", (F.col("v") * 2).alias("node"), "v", "cut_parent", none.alias("region"), "parent", "depth")
    last = made.groupBy("gid", F.col("part").alias("region")).agg(F.max_by("parent", "depth").alias("parent"), F.max("depth").alias("depth"))
    leaf = tree.select("gid", F.col("v").alias("region")).join(last, ["gid", "region"], "left")
    return inner.unionByName(leaf.select("gid", (F.col("region") * 2 + 1).alias("node"), none.alias("v"), none.alias("cut_parent"), "region", "parent", F.coalesce("depth", F.lit(0)).alias("depth")))
