"""How many nodes each node of a graph reaches, and the first of them, without any list of pairs that reach each other."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import numbered, shared_dir, written

#: Longs in a row of bits: a row says which of 64 * WORDS roots reach a node.
WORDS = 8
BITS = [f"b{k}" for k in range(WORDS)]
SOME_NEW = " or ".join(f"new_{b} <> 0" for b in BITS)


def _or(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.bit_or(b).alias(b) for b in BITS])


def spread(pairs: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Roots with their numbers (root, number), and for each round the table (node, block, b*, new_*) of what is known after it.

    A row of the table (node, block, bits) says which roots of a block of 512 reach a node. Each round passes on, over the
    pairs, the bits that were new in the round before, ors them per node and block (before and after the shuffle), and keeps
    those not known yet; cycles need no care. Bits that are new in round k are those of nodes k steps away.
    """
    pairs = written(pairs.select("src", "dst").where("src is not null and dst is not null").distinct(), "reach-pairs")
    own = numbered(roots.select("root").distinct(), ["root"], "number", "reach-roots")
    own = written(own, "reach-roots")
    bit = F.expr("shiftleft(1L, cast(number & 63 as int))")
    word = F.shiftright("number", 6).bitwiseAND(WORDS - 1)
    first = own.join(pairs, F.col("root") == F.col("src")).select(F.col("dst").alias("node"), F.shiftright("number", 9).alias("block"), *[F.when(word == k, bit).otherwise(0).cast("long").alias(b) for k, b in enumerate(BITS)])
    known = written(_or(first, "node", "block").select("*", *[F.col(b).alias(f"new_{b}") for b in BITS]), "reach")
    rounds = [known]
    while True:
        new = known.where(SOME_NEW)
        if new.isEmpty():
            return own, rounds
        passed = new.join(pairs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "block", *[F.col(f"new_{b}").alias(b) for b in BITS])
        passed = _or(passed, "node", "block").withColumnsRenamed({b: f"got_{b}" for b in BITS})
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        both = known.select("node", "block", *BITS).join(passed, ["node", "block"], "full")
        known = written(both.select("node", "block", *[zero(b).bitwiseOR(zero(f"got_{b}")).alias(b) for b in BITS], *[zero(f"got_{b}").bitwiseAND(F.bitwise_not(zero(b))).alias(f"new_{b}") for b in BITS]), "reach")
        rounds.append(known)


def strong_parts(edges: DataFrame) -> DataFrame:
    """(node, part) of the nodes on the cycles of the edges (src, dst); part is one of the nodes that reach each other.

    What no cycle can hold is peeled off from both sides. Then the smallest node that reaches a node is its colour; what of a
    colour reaches its smallest node is one part. The same again for what is left.
    """
    def peeled(left: DataFrame) -> DataFrame:
        count = left.count()
        while count:
            left = left.join(left.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").select("src", "dst")
            left = written(left.join(left.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select("src", "dst"), "peeled")
            before, count = count, left.count()
            if count == before:
                break
        return left

    left, out = peeled(edges), None
    while not left.isEmpty():
        color = left.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node"))
        while True:
            back = left.join(color, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("least"))
            color = written(color.join(back, "node").select("node", F.least("color", "least").alias("color"), (F.col("least") < F.col("color")).alias("changed")), "colors")
            if color.where("changed").isEmpty():
                break
        color = color.select("node", "color")
        of = lambda c: color.select(F.col("node").alias(c), F.col("color").alias(f"{c}_color"))
        inner = written(left.join(of("src"), "src").join(of("dst"), "dst").where("src_color = dst_color").select("src", "dst"), "colors")
        new = written(color.where("node = color"), "parts")
        found = new
        while not new.isEmpty():
            new = written(inner.join(new, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "color").distinct().join(found.select("node"), "node", "left_anti"), "parts")
            found = found.unionByName(new)
        found = written(found.select("node", F.col("color").alias("part")), "parts")
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        left = peeled(written(left, "peeled"))
    none = edges.select(F.col("src").alias("node"), F.col("src").alias("part")).where("false")
    if out is None:
        return none
    # A node by itself is on a cycle only if it is a pair with itself.
    size = out.groupBy("part").agg(F.count("*").alias("n"))
    itself = edges.where("src = dst").select(F.col("src").alias("part"), F.lit(True).alias("itself")).distinct()
    return written(out.join(size, "part").join(itself, "part", "left").where("n > 1 or itself").select("node", "part"), "parts")


def levels(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, level) of the edges (src, dst), the longest way to each node that is on no cycle and behind none, and the greatest level. Each edge goes once all before it have gone.

    What is ready in a round grows with the graph, so it meets the edges by shuffles: sent to all tasks, it would pass through the driver in each round.
    """
    left = edges
    ready = written(left.select(F.col("src").alias("node")).distinct().join(left.select(F.col("dst").alias("node")).hint("merge"), "node", "left_anti"), "levels")
    out, level = [], 0
    while not ready.isEmpty():
        out.append(ready.withColumn("level", F.lit(level)))
        done = ready.withColumnRenamed("node", "src").hint("merge")
        rest = written(left.join(done, "src", "left_anti").select("src", "dst"), "levels")
        met = left.join(done, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        ready = written(met.join(rest.select(F.col("dst").alias("node")).hint("merge"), "node", "left_anti"), "levels")
        left, level = rest, level + 1
    if not out:
        return edges.select(F.col("src").alias("node"), F.lit(0).alias("level")).where("false"), 0
    return written(reduce(DataFrame.unionByName, out), "levels"), level - 1


class Graph(NamedTuple):
    """The nodes (node, id) of a graph, its edges (src, dst) as ids, the cycles' nodes (node, part), the edges between parts, and the levels (node, level) of these up to the last."""

    ids: DataFrame
    edges: DataFrame
    parts: DataFrame
    inner: DataFrame
    level: DataFrame
    last: int


def graph_of(pairs: DataFrame, names: DataFrame | None = None) -> Graph:
    """The graph of the pairs (src, dst), with further nodes (node) if given."""
    pairs = written(pairs.select("src", "dst").where("src is not null and dst is not null").distinct(), "reach-pairs")
    every = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node")))
    every = (every if names is None else every.unionByName(names.select("node").where("node is not null"))).distinct()
    ids = written(numbered(every, ["node"], "id", "reach-ids"), "reach-ids")
    of = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")).hint("merge")
    edges = written(pairs.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), "reach-edges")
    parts = strong_parts(edges)
    inner = written(in_parts(in_parts(edges, parts, "src"), parts, "dst").where("src <> dst").select("src", "dst").distinct(), "reach-edges")
    return Graph(ids, edges, parts, inner, *levels(inner))


def in_parts(rows: DataFrame, parts: DataFrame, c: str) -> DataFrame:
    """rows whose column c names the part of a node on a cycle instead of the node."""
    return rows.join(parts.select(F.col("node").alias(c), F.col("part").alias("of")), c, "left").withColumn(c, F.coalesce("of", c)).drop("of")


def reached(graph: Graph, roots: DataFrame, back: bool = False) -> DataFrame:
    """(node, by), as ids: which of the roots (root) reach which nodes, once each; back: against the edges. A root on a cycle reaches itself.

    The nodes of a cycle are one. A node is worked on once, when all before it are: it gets what reaches these, in one
    distinct, and hands it on to the levels of what comes after it. So no step reads again what earlier ones found. Against
    the edges the levels go from the last to the first.
    """
    turned = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else df
    edges, inner, parts, last = turned(graph.edges), turned(graph.inner), graph.parts, graph.last
    level = graph.level.select("node", (last - F.col("level")).alias("level")) if back else graph.level
    starts = written(graph.ids.join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select(F.col("id").alias("by")), "reach-roots")
    # What each node hands on itself; on a cycle to its own part, too.
    first = edges.join(starts, F.col("src") == F.col("by"), "left_semi").select("dst", F.col("src").alias("by"))
    first = in_parts(first, parts, "dst").join(parts.select(F.col("node").alias("by"), F.col("part").alias("own")), "by", "left")
    own = parts.select(F.col("part").alias("dst"), F.col("node").alias("by")).join(starts, "by", "left_semi")
    first = first.where("own is null or own <> dst").select("dst", "by").unionByName(own.select("dst", "by"))
    at = level.select(F.col("node").alias("dst"), "level")
    onward = written(inner.join(at, "dst").join(level.select(F.col("node").alias("src"), F.col("level").alias("from_level")), "src").select("src", "dst", "level", "from_level"), "reach-edges")
    # A part that nothing but itself touches has no level.
    sent = by_level(first.join(at, "dst", "left").select("dst", "by", F.coalesce("level", F.lit(0)).alias("level")))
    waiting, out = [sent], []
    for k in range(last + 1):
        here = [df.where(F.col("level") == k).select("dst", "by") for df, held in waiting if k in held]
        if not here:
            continue
        now = written(reduce(DataFrame.unionByName, here).distinct(), "reach")
        out.append(now)
        to = onward.where(F.col("from_level") == k).select("src", F.col("dst").alias("to"), "level")
        waiting.append(by_level(now.join(to, F.col("dst") == F.col("src")).select(F.col("to").alias("dst"), "by", "level")))
    if not out:
        return graph.edges.select(F.col("dst").alias("node"), F.col("src").alias("by")).where("false")
    found = reduce(DataFrame.unionByName, out).withColumnRenamed("dst", "node")
    if parts.isEmpty():
        return found
    return found.join(parts.select(F.col("part").alias("node"), F.col("node").alias("member")), "node", "left").select(F.coalesce("member", "node").alias("node"), "by")


def reached_both_ways(graph: Graph, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reached() against the edges and along them, side by side: their rounds are short jobs that wait for each other."""
    with ThreadPoolExecutor(2) as pool:
        up, down = pool.submit(reached, graph, roots, True), pool.submit(reached, graph, roots)
        return up.result(), down.result()


def reaching(pairs: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, id) of the pairs (src, dst), and which roots (root) reach which of them, once each, as ids: (node, by)."""
    graph = graph_of(pairs)
    return graph.ids, reached(graph, roots)


#: Numbers of roots that one list may hold: lists are cut there, so a row, and the names of the roots of one slice, stay bounded.
SLICE = 1 << 18
#: Nodes from which a node gets lists, above which these are put together in groups first.
MANY = 64


def in_slices(numbers: DataFrame, *keys: str) -> DataFrame:
    """(keys, slice, numbers) of the rows (keys, number): the numbers by key as sorted arrays, cut at multiples of SLICE."""
    of = F.floor(F.col("number") / SLICE).cast("int").alias("slice")
    return numbers.groupBy(*keys, of).agg(F.sort_array(F.collect_list("number")).alias("numbers"))


def lists(graph: Graph, starts: DataFrame, back: bool = False) -> DataFrame:
    """(node, slice, numbers): which of the roots (id, number) reach each node or are it, as sorted arrays of numbers; the nodes of a cycle are one, named by its part. back: against the edges.

    As reached(), level by level, but a row is a list: some bytes a pair, where a row for each takes thirty in a shuffle. What a
    node gets is put together at one place, in groups of about as many lists as there are groups.
    """
    turned = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else df
    inner, last = turned(graph.inner), graph.last
    level = graph.level.select("node", (last - F.col("level")).alias("level")) if back else graph.level
    own = in_slices(in_parts(starts.select(F.col("id").alias("node"), "number"), graph.parts, "node"), "node")
    # A part that nothing but itself touches, or a root that nothing touches, has no level.
    sent = own.join(level, "node", "left").select(F.col("node").alias("dst"), "slice", "numbers", F.lit(0).alias("heap"), F.coalesce("level", F.lit(0)).alias("level"))
    n = inner.groupBy("dst").agg(F.count("*").alias("n"))
    heaps = F.when(F.col("n") > MANY, F.ceil(F.sqrt("n"))).otherwise(1)
    at = level.select(F.col("node").alias("dst"), "level")
    onward = inner.join(n, "dst").join(at, "dst").join(level.select(F.col("node").alias("src"), F.col("level").alias("from_level")), "src")
    onward = written(onward.select("src", F.col("dst").alias("to"), F.pmod("src", heaps).cast("int").alias("heap"), "level", "from_level"), "reach-edges")
    waiting, out = [by_level(sent)], []
    together = F.sort_array(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers")
    for k in range(last + 1):
        here = [df.where(F.col("level") == k).select("dst", "slice", "numbers", "heap") for df, held in waiting if k in held]
        if not here:
            continue
        now = reduce(DataFrame.unionByName, here).repartition("dst", "slice")
        now = written(now.groupBy("dst", "slice", "heap").agg(together).groupBy("dst", "slice").agg(together), "reach")
        out.append(now)
        to = onward.where(F.col("from_level") == k).drop("from_level")
        waiting.append(by_level(now.join(to, F.col("dst") == F.col("src")).select(F.col("to").alias("dst"), "slice", "numbers", "heap", "level")))
    if not out:
        return own.where("false")
    return reduce(DataFrame.unionByName, out).withColumnRenamed("dst", "node")


def lists_both_ways(graph: Graph, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lists() against the edges and along them, side by side."""
    with ThreadPoolExecutor(2) as pool:
        up, down = pool.submit(lists, graph, starts, True), pool.submit(lists, graph, starts)
        return up.result(), down.result()


def numbered_roots(graph: Graph, roots: DataFrame) -> DataFrame:
    """(root, id, number) of the roots (root) that are nodes: numbered by level, so the roots between two levels are those between two numbers."""
    own = graph.ids.join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("root"), "id")
    part = own.join(graph.parts.withColumnRenamed("node", "id"), "id", "left").withColumn("node", F.coalesce("part", "id"))
    rows = part.join(graph.level, "node", "left").select("root", "id", F.coalesce("level", F.lit(0)).alias("level"))
    return written(numbered(rows, ["level", "id"], "number", "reach-roots").select("root", "id", F.col("number").cast("int").alias("number"), "level"), "reach-roots")


def edges_around(graph: Graph, starts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges (src, dst and others) with slice and numbers: by each edge the roots (numbered_roots()) in whose view it is, each once in one of its rows; and the lists up and down.

    The view of a root is what it reaches, what reaches it, and itself. An edge is in the views of what its target reaches or is, of what
    reaches its source or is it, and of the roots between both. These have levels between theirs, so only numbers between theirs
    of what reaches the target are looked up among what the source reaches.
    """
    up, down = lists_both_ways(graph, starts)
    counts = starts.groupBy("level").agg(F.count("*").alias("n"))
    every = graph.edges.sparkSession.range(graph.last + 1).select(F.col("id").cast("int").alias("level")).join(counts, "level", "left")
    upto = written(every.select("level", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("level")).alias("upto"), F.coalesce("n", F.lit(0)).alias("n")), "reach-levels")
    of = lambda c: in_parts(graph.edges.select(F.col(c).alias("node")).distinct().withColumn("own", F.col("node")), graph.parts, "node").join(graph.level, "node", "left").withColumn("level", F.coalesce("level", F.lit(0))).join(upto, "level").select(F.col("own").alias(c), F.col("node").alias(f"{c}_part"), F.col("upto").alias(f"{c}_upto"), (F.col("upto") - F.col("n")).alias(f"{c}_before"))
    out = [*edges.columns, "slice", "numbers"]
    placed = written(edges.join(of("src"), "src").join(of("dst"), "dst"), "reach-edges")
    after = placed.join(up.withColumnRenamed("node", "dst_part"), "dst_part").select(out)
    # Within a cycle its own roots are among both.
    mine = F.when(F.col("src_part") == F.col("dst_part"), F.filter("numbers", lambda x: x < F.col("src_before"))).otherwise(F.col("numbers"))
    before = placed.join(down.withColumnRenamed("node", "src_part"), "src_part").withColumn("numbers", mine).select(out)
    far = placed.where("src_upto < dst_before")
    between = far.join(down.withColumnRenamed("node", "dst_part"), "dst_part").select("src", "dst", "src_part", F.explode(F.filter("numbers", lambda x: (x >= F.col("src_upto")) & (x < F.col("dst_before")))).alias("number"))
    most = far.groupBy(F.col("src_part").alias("node")).agg(F.max("dst_before").alias("most"), F.min("src_upto").alias("least"))
    known = up.join(most, "node").select(F.col("node").alias("src_part"), F.explode(F.filter("numbers", lambda x: (x >= F.col("least")) & (x < F.col("most")))).alias("number"))
    between = in_slices(between.join(known, ["src_part", "number"], "left_semi"), "src", "dst").join(edges, ["src", "dst"]).select(out)
    return after.unionByName(before).unionByName(between).where(F.size("numbers") > 0), up, down


def by_level(rows: DataFrame) -> tuple[DataFrame, set[int]]:
    """rows (with column level) written in a folder for each level, and the levels that there are."""
    path = f"{shared_dir(rows.sparkSession)}/reach-{uuid4().hex}"
    rows.write.partitionBy("level").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return back, {r["level"] for r in back.select("level").distinct().collect()}


def counts(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, n): how many nodes each root reaches over the pairs (src, dst); a root on a cycle reaches itself, one without pairs has no row."""
    ids, found = reaching(pairs, roots)
    n = found.groupBy(F.col("by").alias("id")).agg(F.count("*").alias("n"))
    return ids.join(n, "id").select(F.col("node").alias("root"), "n")


def counts_both_ways(pairs: DataFrame) -> DataFrame:
    """(node, n_up, n_down) of all nodes of the pairs (src, dst): how many nodes reach each, and how many it reaches, from one list of who reaches whom."""
    ids, found = reaching(pairs, pairs.select(F.col("src").alias("root")).distinct())
    up = found.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n_up"))
    down = found.groupBy(F.col("by").alias("id")).agg(F.count("*").alias("n_down"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ids.join(up, "id", "left").join(down, "id", "left").select("node", zero("n_up"), zero("n_down"))


def counts_around(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, n_up, n_down) of each root (root): how many nodes reach it over the pairs (src, dst), and how many it reaches. Only pairs with a root are listed."""
    roots = written(roots.select("root").distinct(), "reach-roots")
    graph = graph_of(pairs)
    up, down = (df.groupBy(F.col("by").alias("id")).agg(F.count("*").alias(name)) for df, name in zip(reached_both_ways(graph, roots), ("n_up", "n_down"), strict=True))
    own = graph.ids.join(up, "id", "left").join(down, "id", "left").withColumnRenamed("node", "root")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return roots.join(own, "root", "left").select("root", zero("n_up"), zero("n_down"))


def by_distance(pairs: DataFrame, roots: DataFrame, most: int = 12, farthest: bool = False) -> DataFrame:
    """(root, n, names): how many nodes each root reaches over the pairs (src, dst), and the nearest (or farthest) `most` of them, at one distance by name; a root without pairs has no row.

    The new bits of all rounds, dealt by block and sorted by distance and name, go through a task row by row: it counts for each of
    the 512 roots of a block how many bits have passed, and gives out those up to `most`. So no pair beyond these is ever a row,
    and a task holds one block's counts and one slice of rows.
    """
    own, rounds = spread(pairs, roots)
    steps = [r.where(SOME_NEW).select("block", F.lit(k).alias("dist"), "node", *[F.col(f"new_{b}").alias(b) for b in BITS]) for k, r in enumerate(rounds)]
    every = reduce(DataFrame.unionByName, steps)
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = every.repartition(parts, "block").sortWithinPartitions("block", F.desc("dist") if farthest else F.asc("dist"), "node")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(number: np.ndarray, k: np.ndarray, node: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(k, pa.int64()), node], ["number", "k", "node"])

        def totals(block: int, seen: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(seen)
            return out(block * 64 * WORDS + at, -seen[at], pa.nulls(len(at), pa.string()))

        now, seen = None, np.zeros(64 * WORDS, np.int64)
        for b in batches:
            block, node = b.column("block").to_numpy(), b.column("node").cast(pa.string())
            bits = np.stack([b.column(x).to_numpy() for x in BITS], axis=1).astype("<i8")
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                if block[start] != now:
                    if now is not None:
                        yield totals(now, seen)
                    now, seen = int(block[start]), np.zeros(64 * WORDS, np.int64)
                for at in range(start, stop, 512):
                    ones = np.unpackbits(bits[at : min(at + 512, stop)].view(np.uint8), axis=1, bitorder="little")
                    place = seen + np.cumsum(ones, axis=0, dtype=np.int64)
                    row, root = np.nonzero((ones == 1) & (place <= most))
                    if len(row):
                        yield out(now * 64 * WORDS + root, place[row, root], node.take(pa.array(at + row)))
                    seen = place[-1]
        if now is not None:
            yield totals(now, seen)

    found = rows.mapInArrow(passed, "number long, k long, node string")
    named = F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.struct("k", "node"))))
    sums = found.groupBy("number").agg(F.max(-F.col("k")).alias("n"), F.transform(named, lambda x: x["node"]).alias("names"))
    return own.join(sums, "number").select("root", "n", "names")


def first_names(pairs: DataFrame, roots: DataFrame, most: int = 10) -> DataFrame:
    """(root, names): the first `most` nodes, by name, of all that each root reaches over the pairs (src, dst), as a sorted array.

    Each node passes on only its first names: a name that is among the first of all that a root reaches is also among the first
    of all that any node on the way reaches. Each round passes on the names that were new in the round before.
    """
    pairs = written(pairs.select("src", "dst").where("src is not null and dst is not null").distinct(), "reach-pairs")
    place = F.row_number().over(Window.partitionBy("node").orderBy("name"))
    cut = lambda rows: rows.withColumn("k", place).where(F.col("k") <= most).drop("k")
    known = written(cut(pairs.select(F.col("src").alias("node"), F.col("dst").alias("name"))).withColumn("new", F.lit(True)), "first")
    while not known.where("new").isEmpty():
        passed = known.where("new").join(pairs, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "name").distinct()
        both = known.select("node", "name", F.lit(False).alias("new")).unionByName(passed.withColumn("new", F.lit(True)))
        known = written(cut(both.groupBy("node", "name").agg(F.min("new").alias("new"))), "first")
    rows = known.join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi")
    return rows.groupBy(F.col("node").alias("root")).agg(F.array_sort(F.collect_list("name")).alias("names"))


def counts_and_first(pairs: DataFrame, roots: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Both of the above. Their rounds are short jobs that wait for each other, so the two run side by side."""
    with ThreadPoolExecutor(2) as pool:
        n, names = pool.submit(counts, pairs, roots), pool.submit(first_names, pairs, roots, most)
        return n.result(), names.result()


def both_by_distance(pairs: DataFrame, roots: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """by_distance() against the pairs, farthest first, and along them, nearest first, side by side."""
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    with ThreadPoolExecutor(2) as pool:
        up, down = pool.submit(by_distance, back, roots, most, True), pool.submit(by_distance, pairs, roots, most)
        return up.result(), down.result()
