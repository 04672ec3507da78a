"""Shared folders, size-checked joins and distributed connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies below ``spark.checkpoint.dir``. Only a session of one machine (master local) may leave that unset: a temporary
    folder is then taken and set as checkpoint folder. On a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """As ``stored``, and the shuffle files of that job go when it ends: only the table is read afterwards."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return stored(df, path)
    finally:
        spark.conf.set(name, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """At most so many rows in an Arrow batch of what is written meanwhile: for rows of many kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more: all that followed from them is itself stored."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more, as their results are stored."""
    gc.collect()
    spark._jvm.System.gc()


def small_side(df: DataFrame, rows: int, bound: int = 500_000) -> DataFrame:
    """Broadcast a side whose counted rows are within the bound; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= bound else df


def components(edges: DataFrame, node: str = "long") -> DataFrame:
    """Connected components of undirected edges (src, dst): a row (id, root) for each node that has an edge.

    ``root`` is the smallest id of the component. The method alternates large-star and small-star steps:
    in each, a node's neighbours are linked to its smallest neighbour, first those above the node, then
    those below it, until the edges no longer change. All steps are joins and aggregations with map-side
    minima, so a hub is a skewed join key that Spark splits, never one task's list. Each round is
    written to the shared folder, which bounds lineage. Rounds grow with the logarithm of the longest chain.
    Null ends and self loops carry no link and are left out.
    """
    spark, path = edges.sparkSession, shared_dir(edges.sparkSession)
    e = edges.select(*(F.col(c).cast(node).alias(c) for c in ("src", "dst"))).where("src <> dst")
    e = settled(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), path)

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now, rounds = state(e), 0
    while now[0]:
        both = e.union(e.select("dst", "src"))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        last, path = path, shared_dir(spark)
        e = settled(small.union(low.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct(), path)
        dropped(spark, last)
        before, now, rounds = now, state(e), rounds + 1
        if before == now:
            break
        if rounds > 200:
            raise RuntimeError("components did not settle in 200 rounds")
    return e.select(F.col("src").alias("id"), F.col("dst").alias("root")).union(
        e.select(F.col("dst").alias("id"), F.col("dst").alias("root")).distinct()
    )
