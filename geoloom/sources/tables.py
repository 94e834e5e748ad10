"""Reading polygons and graphs, writing triangles, and counts per polygon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_polygon_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, rejects) of a folder of files: n, then n lines "x y". pid is a hash of the file's path; rejects give path and reason."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("w"))
    files = files.select("path", F.xxhash64("path").alias("pid"), F.expr("try_cast(w[0] as bigint)").alias("n"), F.expr("transform(slice(w, 2, greatest(size(w) - 1, 0)), t -> try_cast(t as double))").alias("c"))
    short = F.size("c") < 2 * F.col("n")
    reason = F.when(F.col("n").isNull(), "no count").when(F.col("n") < 3, "fewer than 3 vertices").when(short, "a coordinate is missing").when(F.exists(F.slice("c", 1, F.greatest(2 * F.col("n"), F.lit(0)).cast("int")), lambda x: x.isNull()), "a coordinate is no number")
    files = files.withColumn("reason", reason)
    ok = files.where("reason is null").select("pid", F.posexplode(F.expr("transform(sequence(0, cast(n as int) - 1), i -> struct(c[2 * i] as x, c[2 * i + 1] as y))")).alias("idx", "v"))
    return ok.select("pid", F.col("idx").cast("long").alias("idx"), "v.x", "v.y"), files.where("reason is not null").select("path", "reason")


def read_vertices(df: DataFrame, pid: str = "pid", idx: str = "idx", x: str = "x", y: str = "y") -> DataFrame:
    """vertices(pid, idx, x, y) from any frame; raises if a column is missing."""
    missing = {pid, idx, x, y} - set(df.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)}")
    return df.select(F.col(pid).cast("long").alias("pid"), F.col(idx).cast("long").alias("idx"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def read_graph(v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """g_vertices with cost 1 where none is given, and g_edges."""
    cost = F.coalesce(F.col("cost").cast("double"), F.lit(1.0)) if "cost" in v.columns else F.lit(1.0)
    return v.select(F.col("gid").cast("long").alias("gid"), F.col("v").cast("long").alias("v"), cost.alias("cost")), e.select(F.col("gid").cast("long").alias("gid"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))


def write_triangles(triangles: DataFrame, path: str, text: bool = False, folders: bool = True) -> None:
    """Parquet, or text: lines "a b c" in one folder for each polygon or, without folders, lines "pid a b c" of all polygons in as many files as the frame has partitions."""
    if text and folders:
        triangles.select("pid", F.concat_ws(" ", "a", "b", "c").alias("line")).write.partitionBy("pid").text(path)
    elif text:
        triangles.select(F.concat_ws(" ", "pid", "a", "b", "c").alias("line")).write.text(path)
    else:
        triangles.write.parquet(path)


def polygon_report(**tables: DataFrame) -> DataFrame:
    """Rows of each table for each pid, in a column named after it. Tables are counted in tasks of their own, not all in one."""
    out = None
    for name, t in tables.items():
        n = t.groupBy("pid").agg(F.count("*").alias("n")).select("pid", *[(F.col("n") if c == name else F.lit(0).cast("long")).alias(c) for c in tables])
        out = n if out is None else out.unionByName(n)
    return out.groupBy("pid").agg(*[F.sum(c).alias(c) for c in tables])
