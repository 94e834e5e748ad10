"""Ranks, running sums and neighbours in an order, for keys of any size.

A window over a key is one task; here rows are sorted by key and order in ranges over all tasks, and what a key has in one
range (a slice) is worked on by itself. Slices hand over their counts, sums or border rows: a row for each, joined back. For
keys that lie in one range the result is that of the window; a giant key is as many tasks as ranges hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut

SLICE, AT = "slice_", "at_"


def sliced(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows with their slice and a number that grows in the order; written, so that both stay."""
    by = [F.col(k) for k in keys] + order
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(AT, F.monotonically_increasing_id())
    return cut(spread.withColumn(SLICE, F.shiftright(AT, 33)), sized=False)  # texts come here too


def _offsets(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each key and slice, the sums over the slices before it."""
    each = rows.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    return each.select(*keys, SLICE, *[F.coalesce(F.sum(n).over(before), F.sum(n).over(before.rowsBetween(0, 0)) * 0).alias(f"{n}_before") for n in sums])


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds sums over the rows of the key up to each row. The order must tell rows of a key apart."""
    rows = sliced(df, keys, order)
    own = Window.partitionBy(*keys, SLICE).orderBy(AT)
    out = rows.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(_offsets(rows, keys, sums), [*keys, SLICE])
    return out.select(*df.columns, *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in sums])


def ranks(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the row number, from 1, of each row among those of its key."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def neighbours(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], around: bool = True) -> DataFrame:
    """Adds prev_ and next_ of the columns: those of the rows before and behind; around: the last row is before the first."""
    rows = sliced(df, keys, order)
    row = F.struct(*columns)
    own = Window.partitionBy(*keys, SLICE).orderBy(AT)
    ends = rows.groupBy(*keys, SLICE).agg(F.min_by(row, AT).alias("first_"), F.max_by(row, AT).alias("last_"))
    w = Window.partitionBy(*keys).orderBy(SLICE)  # one row for each slice
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, behind = F.lag("last_").over(w), F.lead("first_").over(w)
    if around:
        before, behind = F.coalesce(before, F.last("last_").over(whole)), F.coalesce(behind, F.first("first_").over(whole))
    ends = ends.select(*keys, SLICE, before.alias("before_"), behind.alias("behind_"))
    out = rows.withColumns({"prev_": F.lag(row).over(own), "next_": F.lead(row).over(own)}).join(ends, [*keys, SLICE])
    near = lambda side, border: [F.coalesce(F.col(side), F.col(border)).getField(c).alias(f"{side}{c}") for c in columns]
    return out.select(*df.columns, *near("prev_", "before_"), *near("next_", "behind_"))
