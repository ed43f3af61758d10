"""Intermediate tables in the shared folder, and row numbers that no single task has to count."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MARKED: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This application's folder where spark.checkpoint.dir points; a local one only in local mode. It goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/lodestone-tables/{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        _MARKED.add(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(at)
        system.deleteOnExit(at)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df written and read again: its lineage ends there."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame) -> DataFrame:
    """df over all cores, where it is a small table that comes in fewer pieces than there are; a larger one is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores)


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal", start: int = 0) -> DataFrame:
    """df with the running number of each row among those of its keys, from ``start``.

    Rows are dealt by ranges of (keys, order), so a key with many rows is split: they are sorted and numbered as they are written,
    and each range starts where the ones before it end, which takes a table of one row a key and range. Rows move once.
    """
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = kept(ordered.withColumn("__at", F.monotonically_increasing_id()))  # the partition, and 33 bits for the row in it
    dealt = dealt.withColumn("__range", F.shiftright("__at", 33))
    part = [*keys, "__range"]
    size = dealt.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = size.select(*part, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + start).alias("__before"))
    shift = kept(shift) if keys else F.broadcast(shift)  # without keys a row for each range
    return dealt.join(shift, part).withColumn(name, F.col("__at") + F.col("__before")).select(*df.columns, name)
