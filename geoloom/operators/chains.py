"""Dyadic chains and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plane import granularity


def chain_ranges(grades: DataFrame) -> DataFrame:
    """For (pid, p): every grade's chains with their first and last vertex."""
    g = grades.select("pid", "p", F.explode(F.sequence(F.lit(0), F.col("p").cast("int"))).alias("grade"))
    size, last = F.expr("shiftleft(1L, grade)"), F.expr("shiftleft(1L, cast(p as int) - grade) - 1")
    c = g.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chain"))
    return c.select("pid", "grade", "chain", (F.col("chain") * size).alias("start_vertex"), ((F.col("chain") + 1) * size).alias("end_vertex"), granularity("grade").alias("granularity"))


def dyadic_cut(ranges: DataFrame, top: int = 62) -> DataFrame:
    """Cuts [s, e) into the fewest aligned power-of-two pieces of at most 2**top; empty ranges give none.

    A piece (k, l) is left of its range's part of grade k + 1 if l is odd, right of it if r is odd; so
    each grade is decided by itself and no loop is needed. At the top all of l..r-1 are pieces."""
    r = ranges.where("s < e").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(top))))
    unit = F.expr("shiftleft(1L, k)")
    r = r.withColumn("l", F.expr("shiftright(s + shiftleft(1L, k) - 1, k)")).withColumn("r", F.expr("shiftright(e, k)")).where("l < r")
    left = F.when(F.col("l") % 2 == 1, F.col("l"))
    right = F.when((F.col("r") % 2 == 1) & ((F.col("r") - 1 > F.col("l")) | (F.col("l") % 2 == 0)), F.col("r") - 1)
    piece = F.when(F.col("k") == top, F.sequence(F.col("l"), F.col("r") - 1)).otherwise(F.array_compact(F.array(left, right)))
    out = r.withColumn("piece", F.explode(piece))
    return out.select("range_id", F.col("k").alias("grade"), F.col("piece").alias("chain"), (F.col("piece") * unit).alias("start"), ((F.col("piece") + 1) * unit).alias("end"))


def holding(points: DataFrame, ranges: DataFrame, keys: list[str], at: Column, lo: Column, hi: Column, top: int = 13, few: int = 64) -> DataFrame:
    """Each pair of a point and a range of the same keys with lo <= at <= hi, once; both ends are whole numbers. Null ends meet nothing.

    A range of a length from 8**g up to 8**(g + 1) lies in at most nine blocks of 8**g numbers, and a point looks in its own
    block of each grade; so the join is an equi-join on the keys, grade and block and doesn't crowd on the keys.
    Ranges beyond 8**(top + 1) take more blocks of the top grade. Keys of up to `few` ranges take the plain equi-join
    on the keys: a point meets no more than these."""
    size = F.least(F.expr("(length(bin(hi_ - lo_)) - 1) div 3").cast("int"), F.lit(top))
    n = ranges.groupBy(*keys).agg(F.count("*").alias("n_"))
    r = ranges.withColumns({"lo_": lo.cast("long"), "hi_": hi.cast("long")}).where("lo_ <= hi_").join(n, keys)
    p = points.withColumn("at_", at.cast("long"))
    some = p.join(r.where(F.col("n_") <= few).drop("n_"), keys).where("lo_ <= at_ and at_ <= hi_")
    blocks = F.explode(F.expr("sequence(shiftright(lo_, 3 * g_), shiftright(hi_, 3 * g_))"))
    big = r.where(F.col("n_") > few).drop("n_").withColumn("g_", size).withColumn("block_", blocks)
    asked = p.join(n.where(F.col("n_") > few).select(*keys), keys, "left_semi").withColumn("g_", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("block_", F.expr("shiftright(at_, 3 * g_)"))
    many = asked.join(big, [*keys, "g_", "block_"]).where("lo_ <= at_ and at_ <= hi_").drop("g_", "block_")
    return some.unionByName(many).drop("lo_", "hi_", "at_")
