"""What the operators share: the shared working folder, written tables, components of a graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: ASCII white space as the contracts define it: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees; where that is unset, below the context's checkpoint folder or else the warehouse, which are shared as well."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or work_dir(spark)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text as an array: maximal runs of anything but ASCII white space; none for an empty text."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES_RE))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: (a, b) long columns in any direction. Returns (node, root), root the smallest node reachable; nodes without an edge do not appear.
    Each round is two shuffles over the edges still alive and is written to the shared folder; only the number of edges and a checksum reach the driver.
    """
    big = F.greatest("a", "b").alias("u")
    small = F.least("a", "b").alias("v")
    cur = written(edges.where("a <> b").select(big, small).distinct())
    before = None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # An expression over the key gives this side an exchange of its own, so that adaptive execution can split a hot star.
        low = low.select(F.greatest("u", F.lit(-(1 << 63))).alias("u"), "m")
        # large star: larger neighbours move to the smallest one around
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours and the node itself move to the smallest one
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        hook = large.join(low2, "u")
        out = hook.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        nxt = written(out.where("u <> v").distinct())
        state = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(cur)
        cur = nxt
        if state == before:
            break
        before = state
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
