"""Where a plan is cut: tables that several parts of a job read are written once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def shared_folder(df: DataFrame) -> str:
    """The folder below which tables are written: ``spark.checkpoint.dir``; only a session of one machine may leave it unset (tests)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-plans-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Spark takes a file's size for that of its rows. Derived tables repeat most of their values and are a hundredth of it, so tables of millions of rows were sent whole to the driver and to every executor.
COMPRESSION, MANY_TIMES = "spark.sql.sources.fileCompressionFactor", "100.0"


def kept(df: DataFrame) -> DataFrame:
    """The table, computed once and written as Parquet to the shared folder, so that later scans read only the columns they need.

    Joins of what has been written are planned by the size of rows, not of files, where the session says nothing else; what proves small is still sent whole, by its measured size.
    """
    if not df.sparkSession.conf.get(COMPRESSION, None) or float(df.sparkSession.conf.get(COMPRESSION)) == 1.0:
        df.sparkSession.conf.set(COMPRESSION, MANY_TIMES)
    path = f"{shared_folder(df)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their place from 1 in the order of all rows: sorted and numbered range by range, so no task has all of them; only a count for each range meets in one place."""
    sorted_ = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", 33)
    before = W.Window.orderBy("part_").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = sorted_.groupBy(part.alias("part_")).agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("below_"))
    placed = sorted_.withColumn("part_", part).join(F.broadcast(sizes), "part_")
    return placed.withColumn(name, F.col("below_") + F.col("at_").bitwiseAND((1 << 33) - 1) + 1).drop("part_", "at_", "below_")
