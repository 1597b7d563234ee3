"""How rows lie over a cluster: before costly work on each of them, in one order over all partitions, and written for jobs that read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def spread(table: DataFrame) -> DataFrame:
    """A scanned table with a partition for each core at least.

    A small table in one file is one task otherwise, however many cores there are; a table with more partitions than cores is left as it
    lies, without a shuffle. For tables read from files: what has been shuffled already is dealt by Spark's own settings.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Only a session on one machine may do without, and gets one there; a cluster may not."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file:/tmp/checkpoints/steploom")
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder (or over what a path holds) and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """The rows in one order over all partitions, with part and at: the number of the range that a row is in, and its place there.

    Ranges are cut by Spark's sample of the order, sorted each in its own task, and written, so that part and at are the same in all later reads.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    kept = stored(ranged, "ordered")
    return kept.withColumn("part", F.shiftrightunsigned("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
