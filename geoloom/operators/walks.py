"""Walks and tree paths by doubling: rounds are the logarithm of their length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StructType

from ..functions.packed import walks
from ..plans.iterate import counted, cut


def faces(successor: DataFrame, most: int = 40, small: int = 20_000) -> DataFrame:
    """(gid, h, face, pos, size) for a table of half-edge successors (gid, h, next), each the next of one: face is the lowest h on the walk and pos counts from it.

    Graphs of up to `small` rows are an array each and are walked where they are. In larger ones each round knows the lowest h among
    the next 2**k, and the steps to it; as many rounds as the logarithm of the longest face."""
    kind = successor.schema["h"].dataType.simpleString()
    if not _whole(successor.schema["h"].dataType):
        return _doubled(cut(successor), most)
    rows = cut(successor.select("gid", "h", "next"))
    few, large = by_size(rows, small)
    few = few.groupBy("gid").agg(F.collect_list(F.struct("h", "next")).alias("w_"))
    few = few.withColumn("f_", F.arrow_udf(walks, f"array<struct<face:{kind},pos:bigint,size:bigint>>")(F.col("w_")))
    few = few.select("gid", F.explode(F.arrays_zip("w_", "f_")).alias("z_")).select("gid", "z_.w_.h", "z_.f_.*")
    return few if large is None else few.unionByName(_doubled(rows.join(large, "gid", "left_semi"), most))


def by_size(rows: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of graphs that have at most `small`, and the gids of the others; None without any."""
    large = cut(rows.groupBy("gid").agg(F.count("*").alias("n_")).where(F.col("n_") > small).select("gid"))
    return (rows, None) if large.isEmpty() else (rows.join(large, "gid", "left_anti"), large)


def _whole(t: DataType) -> bool:
    return all(_whole(f.dataType) for f in t.fields) if isinstance(t, StructType) else isinstance(t, IntegralType)


def _doubled(successor: DataFrame, most: int) -> DataFrame:
    s = cut(successor.select("gid", "h", "next", F.col("h").alias("face"), F.lit(0).cast("long").alias("steps")))
    for k in range(most):
        n = s.select("gid", F.col("h").alias("next"), F.col("next").alias("next2"), F.col("face").alias("face2"), F.col("steps").alias("steps2"))
        lower = F.col("face2") < F.col("face")
        s, moved = counted(s.join(n, ["gid", "next"]).select("gid", "h", F.col("next2").alias("next"), F.when(lower, F.col("face2")).otherwise(F.col("face")).alias("face"), F.when(lower, F.col("steps2") + 2**k).otherwise(F.col("steps")).alias("steps"), lower.alias("moved")), "moved", s)
        if not moved:
            break
    else:
        raise RuntimeError("faces are longer than the rounds allow")
    size = s.groupBy("gid", "face").agg(F.count("*").alias("size"))
    return s.join(size, ["gid", "face"]).select("gid", "h", "face", F.pmod(F.col("size") - F.col("steps"), F.col("size")).alias("pos"), "size")


def jumps_up(tree: DataFrame, most: int = 60) -> list[DataFrame]:
    """Tables (gid, x, up) of the ancestors 2**k above, for a tree (gid, v, parent)."""
    jumps = [cut(tree.where("parent is not null").select("gid", F.col("v").alias("x"), F.col("parent").alias("up")))]
    for _ in range(most):
        j = jumps[-1]
        above, n = counted(j.join(j.select("gid", F.col("x").alias("up"), F.col("up").alias("up2")), ["gid", "up"]).select("gid", "x", F.col("up2").alias("up")), "true")
        if not n:
            return jumps
        jumps.append(above)
    raise RuntimeError("the tree is too deep, or has a cycle")


def lowest_common(pairs: DataFrame, tree: DataFrame, levels: DataFrame, most: int = 60, jumps: list[DataFrame] | None = None) -> DataFrame:
    """Adds `common`, the lowest common ancestor of u and v in a tree (gid, v, parent) with levels (gid, v, level), to pairs (gid, u, v, ...); null in different trees.

    Ancestors 2**k above by doubling: as many rounds as the logarithm of the depth, not one a level."""
    jumps = jumps if jumps is not None else jumps_up(tree, most)
    s = pairs
    for c in ("u", "v"):
        s = s.withColumn(f"{c}_", F.col(c)).join(levels.select("gid", F.col("v").alias(f"{c}_"), F.col("level").cast("long").alias(f"l{c}")), ["gid", f"{c}_"])

    def lifted(s: DataFrame, k: int) -> DataFrame:
        for c in ("u", "v"):
            s = s.join(jumps[k].select("gid", F.col("x").alias(f"{c}_"), F.col("up").alias(f"{c}up")), ["gid", f"{c}_"], "left")
        return s

    old: tuple[DataFrame, ...] = ()
    for level_first in (True, False):  # the deeper end climbs to the other's level; then both climb to just below their common ancestor
        for k in reversed(range(len(jumps))):
            s = lifted(s, k)
            if level_first:
                moves = {c: F.col(f"l{c}") - 2**k >= F.col(f"l{o}") for c, o in (("u", "v"), ("v", "u"))}
            else:
                moves = dict.fromkeys("uv", F.coalesce((F.col("u_") != F.col("v_")) & (F.col("uup") != F.col("vup")), F.lit(False)))
            s = s.select(*pairs.columns, *[F.when(moves[c], F.col(f"{c}up")).otherwise(F.col(f"{c}_")).alias(f"{c}_") for c in "uv"], *[(F.col(f"l{c}") - F.when(moves[c], 2**k).otherwise(0)).alias(f"l{c}") for c in "uv"])
            s = cut(s, *old)
            old = (s,)
    return lifted(s, 0).select(*pairs.columns, F.when(F.col("u_") == F.col("v_"), F.col("u_")).when(F.col("uup") == F.col("vup"), F.col("uup")).alias("common"))


def tree_path(pairs: DataFrame, tree: DataFrame, most: int = 60) -> DataFrame:
    """(gid, pair, vertex): vertices on the tree path of each pair (gid, pair, u, v), for tree(gid, v, level, parent). Ends in different trees have no path.

    Each end's way to the common ancestor is written out as its numbers of steps, which then go up together, by the bits of
    the number: as many rounds as the logarithm of the depth. A tree deeper than 2**most is an error."""
    jumps = jumps_up(tree, most)
    met = cut(lowest_common(pairs.select("gid", "pair", "u", "v"), tree, tree, most, jumps).where("common is not null"))
    height = lambda c: tree.select("gid", F.col("v").alias(c), F.col("level").cast("long").alias(f"{c}_level"))
    top = met.join(height("common"), ["gid", "common"])
    up = lambda c: top.join(height(c), ["gid", c]).select("gid", "pair", F.col(c).alias("vertex"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{c}_level") - F.col("common_level"))).alias("steps"))
    s = up("u").unionByName(up("v"))
    old: tuple[DataFrame, ...] = ()
    for k, jump in enumerate(jumps):
        moved = s.withColumn("x", F.when(F.shiftright("steps", k).bitwiseAND(F.lit(1).cast("long")) == 1, F.col("vertex"))).join(jump, ["gid", "x"], "left")
        s = cut(moved.select("gid", "pair", F.coalesce("up", "vertex").alias("vertex"), "steps"), *old)
        old = (s,)
    return s.select("gid", "pair", "vertex").distinct()
