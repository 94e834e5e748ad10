"""Connected components of a link table by contraction.

Each round gives every node the neighbour (or itself) of lowest random rank, then replaces the
links' ends by these labels; links inside one label vanish. A fixed share of the nodes is expected to
vanish each round, whatever the shape of the graph (chains and stars alike). Labels are composed with
the labels of the next round as the rounds go. All steps are joins and aggregations; each round is
written as a table, so that lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in a link; nodes of one component share the root. Links with a null end and loops are left out."""
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    whole = None
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("r"), F.col(c).alias("x"))
        both = edges.select("a", rank("b").alias("n")).unionByName(edges.select(F.col("b").alias("a"), rank("a").alias("n")))
        step = both.groupBy("a").agg(F.min("n").alias("n"))
        step = written(step.select(F.col("a").alias("node"), F.least("n", rank("a")).getField("x").alias("root")), "cc-labels")
        if whole is None:
            whole = step
        else:
            after = step.select(F.col("node").alias("root"), F.col("root").alias("then"))
            whole = written(whole.join(after, "root", "left").select("node", F.coalesce("then", "root").alias("root")), "cc-labels")
        one = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        two = one.join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        edges = written(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-links")
    else:
        raise RuntimeError(f"links are left after {max_rounds} rounds")
    if whole is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return whole
