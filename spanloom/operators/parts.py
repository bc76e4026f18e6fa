"""Connected parts of a graph, and work that is done part by part."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written

#: Rows that a part may have to be worked on in one task; rows that one call gets, of as many parts as it takes.
PART_ROWS, CALL_ROWS = 1_000_000, 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, root), root the smallest node of its component, for every node that has an edge to another.

    Alternating large-star and small-star steps: each node's edges move to the smallest neighbour
    known, so O(log n) rounds suffice. Each round is two aggregations with map-side minima and two
    equi-joins on narrow rows, written to the shared folder; adaptive execution splits hubs.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = written(now, "edges")
    before = None
    while True:
        count = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if count == before or not count[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = count
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), "m"), F.struct(F.col("v").alias("x"), "m"))).alias("e")).select(F.col("e.x").alias("u"), F.col("e.m").alias("v"))
        now = written(small.where("u > v").distinct(), "edges")


def sized(rows: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """rows (with column part) of the parts of up to part_rows rows, and those of larger parts."""
    large = written(rows.groupBy("part").count().where(F.col("count") > part_rows).select("part"), "large-parts")
    if large.isEmpty():
        return rows, rows.where("false")
    return rows.join(large, "part", "left_anti").select(rows.columns), rows.join(large, "part", "left_semi").select(rows.columns)


def by_part(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `work` makes of each part (rows with column part). Small parts share calls, dealt by the hash of the part."""
    calls = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // CALL_ROWS)

    def each(call: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([work(part) for _, part in call.groupby("part", sort=False)], ignore_index=True)

    return rows.withColumn("call", F.pmod(F.xxhash64("part"), F.lit(calls))).groupBy("call").applyInPandas(each, schema)
