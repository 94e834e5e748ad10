"""Column expressions over coordinates; all are evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def orient2d(ax, ay, bx, by, cx, cy) -> Column:
    """(b - a) x (c - a): positive if a, b, c turn left."""
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def convexity(turn: Column) -> Column:
    """convex, reflex or collinear by the sign of a turn."""
    return F.when(turn > 0, "convex").when(turn < 0, "reflex").otherwise("collinear")


def x_at(ax, ay, bx, by, y) -> Column:
    """x where the line through a and b has height y; null for a horizontal line."""
    ax, ay, bx, by, y = map(col, (ax, ay, bx, by, y))
    return F.when(ay != by, ax + (y - ay) * ((bx - ax) / (by - ay)))


def edge_x(ax, ay, bx, by, y) -> Column:
    """x_at, or the middle of a horizontal edge; null for an unknown edge."""
    return F.coalesce(x_at(ax, ay, bx, by, y), (col(ax) + col(bx)) / 2)


def y_order(y, x, idx) -> Column:
    """A value that sorts points from low to high; ties by x, then by index."""
    return F.struct(col(y).alias("y"), col(x).alias("x"), col(idx).alias("i"))


def y_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two values of y_order."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def granularity(level) -> Column:
    """2 to the power of a fifth of the level, rounded up."""
    return F.expr(f"shiftleft(1L, cast(({level} + 4) div 5 as int))")
