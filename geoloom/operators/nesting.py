"""Nested ranges: the innermost one around each of many ranges, by one ordered pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut
from ..plans.ordered import running


def innermost(ranges: DataFrame, asked: DataFrame, keys: list[str], small: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """((keys, range_id, outer), (keys, ask_id, range_id)): the smallest of ranges(keys, range_id, lo, hi) around each of them, and around each of asked(keys, ask_id, lo, hi); null without one.

    Ranges of a key are nested or apart; they may share ends, and one may begin where another ends. lo and hi, both included, are of any type
    that can be sorted, lo <= hi; ask_id is of any type. Of equal ranges that with the lower id is the outer one. A range of no length holds nothing, and what begins where a range ends isn't in it.

    Begins and ends are sorted once; the depth of each is a running sum, and the range around is the last one that
    began a level up. So work doesn't grow with the depth, and a key may be any number of tasks. Keys of up to `small` rows take windows over the key
    in place of sorts in ranges (plans.ordered): one shuffle, and nothing is written."""
    none, unasked = F.lit(None).cast("long"), F.lit(None).cast(asked.schema["ask_id"].dataType)
    event = lambda t, at, phase, kind, i, step, ask=unasked: t.select(*keys, F.col(at).alias("at"), F.lit(phase).alias("phase"), "hi", F.lit(kind).alias("kind"), i.alias("id"), F.lit(step).cast("long").alias("step"), ask.alias("ask"))
    wide, flat, own = ranges.where("lo < hi"), ranges.where("lo = hi"), F.col("range_id")
    events = event(wide, "lo", 1, 0, own, 1).unionByName(event(wide, "hi", 0, 1, own, -1)).unionByName(event(flat, "lo", 1, 2, own, 0)).unionByName(event(asked, "lo", 1, 3, none, 0, F.col("ask_id")))
    order = [F.col("at"), F.col("phase"), F.col("hi").desc(), F.col("kind"), F.col("id")]
    events = cut(events)
    large = cut(events.groupBy(*keys).agg(F.count("*").alias("n_")).where(F.col("n_") > small).select(*keys))
    if large.isEmpty():
        return _asked(_windowed(events, keys, order), keys)
    around, inner = _asked(_windowed(events.join(large, keys, "left_anti"), keys, order), keys)
    wide = _asked(_ranged(events.join(large, keys, "left_semi"), keys, order), keys)
    return around.unionByName(wide[0]), inner.unionByName(wide[1])


def _windowed(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(keys, kind, id, ask, range_id): the range around each range and ask; both windows lie on one shuffle by the keys."""
    rows = events.repartition(*keys).withColumn("depth", F.sum("step").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    opens = F.col("kind") == 0
    # a range stands twice: as it begins, and as what asks for the one a level up
    begun = F.struct(F.col("depth").alias("level"), F.col("id").alias("begun"), F.lit(None).cast("int").alias("kind"))
    want = F.struct((F.col("depth") - opens.cast("long")).alias("level"), F.lit(None).cast("long").alias("begun"), F.col("kind"))
    both = rows.where("kind <> 1").select(*keys, "at", "phase", "hi", F.col("kind").alias("of_"), "id", "ask", F.explode(F.when(opens, F.array(want, begun)).otherwise(F.array(want))).alias("e_")).select("*", "e_.*")
    by = Window.partitionBy(*keys, "level").orderBy("at", "phase", F.desc("hi"), "of_", "id", F.col("begun").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("range_id", F.last("begun", ignorenulls=True).over(by)).where("kind is not null").select(*keys, "kind", "id", "ask", "range_id")


def _asked(got: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    around = got.where("kind in (0, 2)").select(*keys, F.col("id").alias("range_id"), F.col("range_id").alias("outer"))
    return around, got.where("kind = 3").select(*keys, F.col("ask").alias("ask_id"), "range_id")


def _ranged(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The same for keys of any size."""
    none = F.lit(None).cast("long")
    # ids tell the rows of a key apart
    events = cut(events.withColumn("id", F.coalesce("id", F.monotonically_increasing_id())))
    asks = events.where("kind = 3").select(*keys, "kind", "id", "ask")
    events = events.drop("ask")
    placed = running(running(events, keys, order, {"depth": F.col("step")}).where("kind <> 1"), keys, order, {"nth": F.lit(1).cast("long")})
    placed = cut(placed.select(*keys, "kind", "id", "depth", "nth"))
    # a level's begins in order, and what asks for the last of them before it
    begun = placed.where("kind = 0").select(*keys, F.col("depth").alias("level"), "nth", F.lit(1).cast("long").alias("one"), F.col("id").alias("range_id"), none.alias("kind"), none.alias("id"))
    level = F.when(F.col("kind") == 0, F.col("depth") - 1).otherwise(F.col("depth"))
    want = placed.select(*keys, level.alias("level"), "nth", F.lit(0).cast("long").alias("one"), none.alias("range_id"), F.col("kind").cast("long").alias("kind"), "id")
    by = [*keys, "level"]
    counted = cut(running(begun.unionByName(want), by, [F.col("nth"), F.col("one")], {"count": F.col("one")}))
    inner = counted.where("one = 1").select(*by, "count", "range_id")
    got = counted.where("one = 0").drop("range_id").join(inner, [*by, "count"], "left")
    return got.join(asks, [*keys, "kind", "id"], "left").select(*keys, "kind", "id", "ask", "range_id")
