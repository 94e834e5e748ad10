"""Triangulation of simple polygons by trapezoids, diagonals and unimonotone pieces."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packed import PIECES, in_parts, split
from ..functions.plane import orient2d
from ..plans.iterate import cut
from ..sources.tables import polygon_report
from .graphs import faces
from .rings import orient_ccw, pad_ring, ring_edges, ring_neighbors
from .visibility import region_tables, trapezoids

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

def classify_trapezoids(traps: DataFrame, vertices: DataFrame) -> DataFrame:
    """class A if top and bottom are neighbours on the ring, else B."""
    n = vertices.groupBy("pid").agg(F.count("*").alias("n"))
    return traps.join(n, "pid").withColumn("class", F.when(F.pmod(F.col("top_v") - F.col("bottom_v"), F.col("n")).isin(1) | (F.pmod(F.col("bottom_v") - F.col("top_v"), F.col("n")) == 1), "A").otherwise("B"))


def diagonals(traps: DataFrame, vertices: DataFrame) -> DataFrame:
    """(pid, u, v), u < v: the vertex pairs of class B, each once."""
    return classify_trapezoids(traps, vertices).where("class = 'B'").select("pid", F.least("top_v", "bottom_v").alias("u"), F.greatest("top_v", "bottom_v").alias("v")).distinct()


def split_by_diagonals(vertices: DataFrame, diags: DataFrame, small: int = 2000) -> DataFrame:
    """(pid, piece, pos, idx): the ring cut along diagonals that don't cross; a polygon without diagonals is one piece."""
    few, many = pieces(vertices.select("pid", "idx", *[F.col(c) if c in vertices.columns else F.lit(None).cast("double").alias(c) for c in "xy"]), diags, small)
    return (few if many is None else few.unionByName(many)).select("pid", "piece", "pos", "idx")


def pieces(vertices: DataFrame, diags: DataFrame, small: int = 2000) -> tuple[DataFrame, DataFrame | None]:
    """Pieces with coordinates (pid, piece, pos, idx, size, x, y) of polygons of up to `small` vertices, and those of larger ones; None without any.

    The former are an array each, split where it is: with diagonals of trapezoids, which lie by polygon, the one shuffle is that of the vertices, and the rows still lie by polygon."""
    v = vertices.select("pid", "idx", "x", "y")
    big = cut(v.groupBy("pid").agg(F.count("*").alias("n_")).where(F.col("n_") > small).select("pid"))
    some = not big.isEmpty()
    own = v.join(big, "pid", "left_anti") if some else v
    rings = own.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("v_"))
    across = diags.groupBy("pid").agg(F.collect_list(F.struct("u", "v")).alias("d_"))
    both = rings.join(across, "pid", "left").withColumn("d_", F.coalesce("d_", F.array().cast(across.schema["d_"].dataType)))
    few = both.select("pid", F.inline(F.arrow_udf(split, PIECES)("v_", "d_"))).select("pid", "piece", "pos", "idx", "size", "x", "y")
    if not some:
        return few, None
    wide = v.join(big, "pid", "left_semi")
    return few, _walked(wide, diags.join(big, "pid", "left_semi")).join(wide, ["pid", "idx"]).select(*few.columns)


def _walked(vertices: DataFrame, diags: DataFrame) -> DataFrame:
    """Pieces of giant polygons.

    Around a vertex the neighbours lie by their distance along the ring, so the edge that follows on
    a piece's border is the neighbour before in that order, with no angles needed."""
    n = vertices.groupBy("pid").agg(F.count("*").alias("n"))
    ring_out = vertices.join(n, "pid").select("pid", F.col("idx").alias("at"), ((F.col("idx") + 1) % F.col("n")).alias("to"), "n")
    ring_in = ring_out.select("pid", F.col("to").alias("at"), F.col("at").alias("to"), "n")
    d = diags.join(n, "pid")
    across = d.select("pid", F.col("u").alias("at"), F.col("v").alias("to"), "n").unionByName(d.select("pid", F.col("v").alias("at"), F.col("u").alias("to"), "n"))
    around = ring_out.unionByName(ring_in).unionByName(across).withColumn("turn", F.pmod(F.col("to") - F.col("at"), F.col("n")))
    before = F.lag("to").over(Window.partitionBy("pid", "at").orderBy("turn"))
    after = around.withColumn("then", before).where("then is not null")
    half = after.select(F.col("pid").alias("gid"), F.struct(F.col("to").alias("tail"), F.col("at").alias("head")).alias("h"), F.struct(F.col("at").alias("tail"), F.col("then").alias("head")).alias("next"))
    f = faces(half)
    return f.select(F.col("gid").alias("pid"), F.col("face").alias("piece"), "pos", F.col("h.tail").alias("idx"), "size")


def mountain_base(pieces: DataFrame) -> DataFrame:
    """pieces with coordinates (pid, piece, pos, idx, x, y) -> per piece: top and bottom vertex and whether they are neighbours (unimonotone), the start of the chain and its direction."""
    low, high = F.struct("y", "x", "idx"), F.struct("y", "x", "idx")
    p = pieces.groupBy("pid", "piece").agg(F.max_by(F.struct("idx", "pos"), high).alias("t"), F.min_by(F.struct("idx", "pos"), low).alias("b"), F.count("*").alias("size"))
    down = F.pmod(F.col("t.pos") - F.col("b.pos"), F.col("size")) == 1  # the border goes from the bottom straight to the top, so the chain goes down
    up = F.pmod(F.col("b.pos") - F.col("t.pos"), F.col("size")) == 1
    return p.select("pid", "piece", "size", F.col("t.idx").alias("top"), F.col("b.idx").alias("bottom"), F.when(down, F.col("t.pos")).when(up, F.col("b.pos")).alias("start_pos"), F.when(down, "down").when(up, "up").alias("direction"))


TRIANGLES = "array<struct<a:long,b:long,c:long>>"


@in_parts
def _cut_ears(chains: pa.Array) -> pa.Array:
    """Triangles of unimonotone chains, given from one end of the base to the other, the inside to the left: one pass with a stack each, all chains of the batch at once.

    In a step every chain cuts the corner on top of its stack off, if it turns left or not at all, or puts its next vertex there."""
    size = chains.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    flat = chains.flatten()
    idx, x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("idx", "x", "y"))
    stack = np.zeros(first[-1], np.int64)  # of each chain from its first place on
    high, at = first[:-1].copy(), first[:-1].copy()  # one past the top of each stack; the next vertex
    found, of = [], []
    live = np.flatnonzero(size > 0)
    while len(live):
        v, top = at[live], high[live]
        two = top - first[live] > 1
        a, b = stack[np.where(two, top - 2, 0)], stack[np.where(two, top - 1, 0)]
        cut_off = two & ((x[b] - x[a]) * (y[v] - y[a]) - (y[b] - y[a]) * (x[v] - x[a]) >= 0)
        found.append(np.stack([idx[a[cut_off]], idx[b[cut_off]], idx[v[cut_off]]]))
        of.append(live[cut_off])
        high[live[cut_off]] -= 1
        put = live[~cut_off]
        stack[high[put]] = at[put]
        high[put] += 1
        at[put] += 1
        live = live[at[live] < first[live + 1]]
    of = np.concatenate(of or [np.zeros(0, np.int64)])
    order = np.argsort(of, kind="stable")
    a, b, c = np.concatenate(found or [np.zeros((3, 0), np.int64)], axis=1)[:, order]
    cut_at = np.searchsorted(of[order], np.arange(len(size) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut_at), pa.StructArray.from_arrays([pa.array(z, pa.int64()) for z in (a, b, c)], ["a", "b", "c"]))


def triangulate_monotone(pieces: DataFrame, small: int = 5000, most: int = 60) -> DataFrame:
    """(pid, a, b, c) for unimonotone pieces with coordinates; others are left out (see mountain_base).

    Chains of up to `small` vertices are cut in one pass each. A longer one is first split at the
    vertex closest to its base line: that triangle is empty, and both rests are chains again."""
    p = pieces if "size" in pieces.columns else pieces.withColumn("size", F.count("*").over(Window.partitionBy("pid", "piece")))
    done = [_in_one_pass(p.where(F.col("size") <= small))]
    p = p.where(F.col("size") > small)
    base = mountain_base(p.drop("size")).where("direction is not null and size >= 3")
    p = p.drop("size").join(base.select("pid", "piece", "size", "start_pos"), ["pid", "piece"])
    p = cut(p.select("pid", F.struct("piece", F.lit("").alias("path")).alias("chain"), F.pmod(F.col("pos") - F.col("start_pos"), F.col("size")).cast("long").alias("k"), "idx", "x", "y", "size"))
    for _ in range(most):
        short = p.where(F.col("size") <= small).groupBy("pid", "chain").agg(F.sort_array(F.collect_list(F.struct("k", "idx", "x", "y"))).alias("c"))
        done.append(short.select("pid", F.inline(F.arrow_udf(_cut_ears, TRIANGLES)("c"))))
        long_ = p.where(F.col("size") > small)
        if long_.isEmpty():
            break
        w = Window.partitionBy("pid", "chain")
        end = F.struct("idx", "x", "y")
        q = long_.withColumns({"s": F.min_by(end, "k").over(w), "z": F.max_by(end, "k").over(w), "m": F.max("k").over(w)})
        off = F.struct(F.abs(orient2d("s.x", "s.y", "z.x", "z.y", "x", "y")), "k")
        j = cut(q.withColumn("w", F.min_by(F.struct("idx", "k"), F.when((F.col("k") > 0) & (F.col("k") < F.col("m")), off)).over(w)))
        done.append(j.where("k = 0").select("pid", F.col("s.idx").alias("a"), F.col("w.idx").alias("b"), F.col("z.idx").alias("c")))
        longer = lambda side: F.struct("chain.piece", F.concat("chain.path", F.lit(side)).alias("path")).alias("chain")
        left = j.where("k <= w.k").select("pid", longer("l"), "k", "idx", "x", "y", (F.col("w.k") + 1).alias("size"))
        right = j.where("k >= w.k").select("pid", longer("r"), (F.col("k") - F.col("w.k")).alias("k"), "idx", "x", "y", (F.col("m") - F.col("w.k") + 1).alias("size"))
        p = cut(left.unionByName(right).where("size >= 3"))
    else:
        raise RuntimeError(f"pieces are too long after {most} rounds")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _in_one_pass(pieces: DataFrame) -> DataFrame:
    """Triangles of the unimonotone ones of pieces with coordinates and size, an array each; rows that lie by polygon stay where they are."""
    corner = F.struct("pos", "idx", "x", "y")
    by = F.struct("y", "x", "idx")
    p = pieces.groupBy("pid", "piece").agg(F.sort_array(F.collect_list(corner)).alias("c_"), F.max_by("pos", by).alias("t_"), F.min_by("pos", by).alias("b_"), F.count("*").alias("n_"))
    start = F.when(F.pmod(F.col("t_") - F.col("b_"), F.col("n_")) == 1, F.col("t_")).when(F.pmod(F.col("b_") - F.col("t_"), F.col("n_")) == 1, F.col("b_")).cast("int")
    p = p.withColumn("s_", start).where("n_ >= 3 and s_ is not null")
    chain = F.concat(F.expr("slice(c_, s_ + 1, n_)"), F.expr("slice(c_, 1, s_)"))
    return p.select("pid", F.inline(F.arrow_udf(_cut_ears, TRIANGLES)(chain)))


def triangulate_with(vertices: DataFrame, traps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triangles, pieces that are not unimonotone) from given trapezoids of counter-clockwise polygons."""
    v = vertices.select("pid", "idx", "x", "y")
    few, many = pieces(v, diagonals(traps, v))
    if many is None:
        return _in_one_pass(few), mountain_base(few).where("direction is null")
    many = cut(many)
    return _in_one_pass(few).unionByName(triangulate_monotone(many)), mountain_base(few.unionByName(many)).where("direction is null")


def triangulate(vertices: DataFrame) -> DataFrame:
    """(pid, a, b, c): n - 2 triangles for each simple polygon, whichever way round it is given."""
    v = cut(orient_ccw(vertices))
    return triangulate_with(v, trapezoids(v))[0]


def fan_faces(face_rows: DataFrame) -> DataFrame:
    """Triangles (gid, face, a, b, c) from each face's first vertex, for rows (gid, face, pos, v) of at least 3."""
    w = Window.partitionBy("gid", "face").orderBy("pos")
    r = face_rows.select("gid", "face", "pos", "v", F.first("v").over(w).alias("a"), F.lead("v").over(w).alias("c"))
    return r.where("c is not null and pos > 0").select("gid", "face", "a", F.col("v").alias("b"), "c")


def ring_fan(vertices: DataFrame) -> DataFrame:
    """The fan of a convex ring from vertex 0."""
    r = ring_neighbors(vertices, ("idx",))
    return r.where("idx > 0 and next_idx > idx").select("pid", F.lit(0).cast("long").alias("a"), F.col("idx").alias("b"), F.col("next_idx").alias("c"))


def polygon_counts(vertices: DataFrame) -> DataFrame:
    """(pid, vertices, padded, edges, grades, regions, chords, arcs, triangles) of counter-clockwise polygons: rows of each table that they give. Chords of no length don't count."""
    regions, arcs, chords = (t.withColumnRenamed("map_id", "pid") for t in region_tables(vertices))
    out = polygon_report(vertices=vertices, padded=pad_ring(vertices), edges=ring_edges(vertices), regions=regions, chords=chords.where("not is_null_length"), arcs=arcs, triangles=triangulate(vertices))
    grades = F.length(F.bin(F.col("padded") - 1)).cast("long")  # padded is 2**p + 1
    return out.select("pid", "vertices", "padded", "edges", grades.alias("grades"), "regions", "chords", "arcs", "triangles")
