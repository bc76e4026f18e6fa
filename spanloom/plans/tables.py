"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is not set, a new local folder if driver and executors are one process (as in tests); else an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.spanloom.local.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
        found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.spanloom.local.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written once and read again: cuts lineage in loops, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list, name: str, tag: str) -> DataFrame:
    """df with the long column `name`: its place, from 0, in the order of the keys. Sorted by ranges and numbered part by part, so that no task holds all.

    The rows are written first: finding the ranges reads them once more, and would else work them out twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(written(df, tag).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()), tag)
    part = F.shiftright(name, 33)
    # One row per part: how many rows stand before it.
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col(name).bitwiseAND(2**33 - 1)
    return rows.join(F.broadcast(before), part == F.col("part")).withColumn(name, place).drop("part", "before")
