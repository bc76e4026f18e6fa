"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with native DataFrame operations only.

The ring is cut into arcs of equal length. One aggregation counts the documents of each arc; the
counts (at most `arcs` rows, whatever the input) are placed on the driver: each arc goes to the shard
of the next virtual node clockwise, and what finds its shard full goes on clockwise. Documents then
find their shard by the arc and their place within it. Law `rows`: shard capacities add up to the
number of documents and differ by at most one, so the shards do too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 16
VIRTUAL_NODES = 64
ARCS = 16_384


def ring(shards: int, virtual_nodes: int, arcs: int) -> list[tuple[int, int]]:
    """(arc, shard) of the virtual nodes in ring order. A shard's nodes depend on its number only, so that more shards leave the nodes of the others in place."""
    at = lambda s, v: int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:13], 16) * arcs >> 52
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def place(counts: dict[int, int], shards: int, virtual_nodes: int, arcs: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot): which of an arc's documents, by their place in it, go where.

    counts: documents of each arc. Capacities are total / shards, rounded up for the first total % shards
    shards and down for the others. In each round every shard takes what waits at its nodes, in ring order,
    until it is full; the rest moves clockwise to the next node of a shard with room. A round that leaves
    something has filled a shard, and capacities add up to the total: at most `shards` rounds.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    nodes = ring(shards, virtual_nodes, arcs)
    places = [a for a, _ in nodes]
    waiting = [(arc, 0, n, bisect_left(places, arc) % len(nodes)) for arc, n in sorted(counts.items()) if n]
    out = []
    while waiting:
        full, left = [not r for r in room], []
        for arc, lo, hi, node in waiting:
            while full[nodes[node][1]]:
                node = (node + 1) % len(nodes)
            s = nodes[node][1]
            if n := min(hi - lo, room[s]):
                out.append((arc, lo, lo + n, s, used[s]))
                used[s] += n
                room[s] -= n
            if lo + n < hi:
                left.append((arc, lo + n, hi, node))
        waiting = left
    return out


def shard(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, arcs: int = ARCS) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot (from 0 without gaps in its shard).

    A document's place on the ring comes from its id; null ids take the text's crc32 instead. Within an arc
    documents go by hash, id, crc32 and size; rows alike in all are interchangeable. Equal texts are not
    kept together: a group of copies may be larger than a shard. Null text has size 1. Fewer documents than
    shards leave shards empty; an empty table gives an empty result. Reruns agree, and so does any
    partitioning of the input.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(body)
    position = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("crc32:"), crc.cast("string"))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), crc.alias("text_crc32"), position.alias("h"))
    arc = F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(arcs).cast("long"), 31).cast("int")
    rows = written(rows.withColumn("arc", arc), "shard")
    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}  # at most `arcs` rows
    placed = spark.createDataFrame(place(counts, shards, virtual_nodes, arcs), "arc int, lo long, hi long, shard int, first long")
    within = Window.partitionBy("arc").orderBy("h", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    rows = rows.withColumn("n", F.row_number().over(within).cast("long") - 1).join(placed, "arc").where("n >= lo and n < hi")
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("n") - F.col("lo")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
