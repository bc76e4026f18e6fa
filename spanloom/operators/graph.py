"""The dependency graph: edges, closure, cycles, levels, order."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..plans.tables import numbered, written
from . import reach
from .parts import PART_ROWS, by_part, components, sized


def edges(models: DataFrame) -> DataFrame:
    """(dependent, ref, ord): references, then sources as source.schema.table; ord is the place among the dependent's. Dangling references are kept."""
    source = F.transform("sources", lambda s: F.concat_ws(".", F.lit("source"), s["schema"], s["table"]))
    return models.select(F.col("name").alias("dependent"), F.posexplode(F.array_distinct(F.concat("refs", source))).alias("ord", "ref"))


def nodes(models: DataFrame) -> DataFrame:
    """(id, layer, type): models and sources."""
    source = models.select(F.explode("sources").alias("s")).select(F.concat_ws(".", F.lit("source"), "s.schema", "s.table").alias("id"), F.lit("source").alias("layer"), F.lit("source_node").alias("type")).distinct()
    return models.select(F.col("name").alias("id"), "layer", "type").unionByName(source.join(models.select(F.col("name").alias("id")), "id", "left_anti"))


def dependents(models: DataFrame) -> DataFrame:
    """(ref, dependents, n): who refers to each node of the graph."""
    known = nodes(models).select(F.col("id").alias("ref"))
    return edges(models).join(known, "ref", "left_semi").groupBy("ref").agg(F.array_sort(F.collect_list("dependent")).alias("dependents")).withColumn("n", F.size("dependents").cast("long"))


def closure(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, dist): what each root reaches over the pairs (src, dst), and in how many steps at least; a root on a cycle reaches itself.

    Breadth first from all roots at once: each round joins the newest nodes with the pairs and keeps what is new.
    Rounds are written to the shared folder, so plans stay short whatever the depth.
    """
    pairs = written(pairs.select("src", "dst").distinct(), "pairs")
    new = written(roots.select(F.col("root")).distinct().join(pairs, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(1).alias("dist")).distinct(), "reach")
    reached, step = new, 1
    while not new.isEmpty():
        step += 1
        new = new.join(pairs, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().join(reached, ["root", "node"], "left_anti")
        new = written(new.withColumn("dist", F.lit(step)), "reach")
        reached = reached.unionByName(new)
        if step % 8 == 0:
            reached = written(reached, "reach")
    return reached


def downstream(models: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Closure along dependents, from all nodes or the given roots (root)."""
    e = edges(models)
    return closure(e.select(F.col("ref").alias("src"), F.col("dependent").alias("dst")), nodes(models).select(F.col("id").alias("root")) if roots is None else roots)


def upstream(models: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Closure along references, dangling names included."""
    e = edges(models)
    return closure(e.select(F.col("dependent").alias("src"), F.col("ref").alias("dst")), models.select(F.col("name").alias("root")) if roots is None else roots)


def trimmed(models: DataFrame) -> DataFrame:
    """Edges between models that remain when models without open references, and those that nothing refers to, are peeled off again and again: all cycles, and what lies between them."""
    left = written(edges(models).join(models.select(F.col("name").alias("ref")), "ref", "left_semi").select("dependent", "ref"), "trim")
    count = left.count()
    while count:
        left = left.join(left.select(F.col("dependent").alias("ref")).distinct(), "ref", "left_semi").select("dependent", "ref")
        left = written(left.join(left.select(F.col("ref").alias("dependent")).distinct(), "dependent", "left_semi").select("dependent", "ref"), "trim")
        before, count = count, left.count()
        if count == before:
            break
    return left


def cycle_nodes(models: DataFrame) -> DataFrame:
    """(name) of the models that reach themselves. Only what trimming leaves is closed over."""
    left = trimmed(models)
    reached = closure(left.select(F.col("dependent").alias("src"), F.col("ref").alias("dst")), left.select(F.col("dependent").alias("root")))
    return reached.where("root = node").select(F.col("root").alias("name"))


def levels(models: DataFrame) -> DataFrame:
    """(name, level): the longest way to a model without references to models; only models that are on no cycle and behind none."""
    e = written(edges(models).join(models.select(F.col("name").alias("ref")).hint("merge"), "ref", "left_semi").select("dependent", "ref"), "levels")
    first = models.select("name").join(e.select(F.col("dependent").alias("name")).hint("merge"), "name", "left_anti").withColumn("level", F.lit(0))
    later, _ = reach.levels(e.select(F.col("ref").alias("src"), F.col("dependent").alias("dst")))
    return first.unionByName(later.where("level > 0").select(F.col("node").alias("name"), "level"))


def walk(part: pd.DataFrame) -> pd.DataFrame:
    """(path, nodes): one cycle for each back edge of a depth-first walk over the edges (dependent, ref), in the order of names; each set of nodes once."""
    refs: dict[str, list[str]] = {}
    for a, b in sorted(zip(part["dependent"], part["ref"], strict=True)):
        refs.setdefault(a, []).append(b)
    found, done = {}, set()
    for start in refs:  # sorted
        if start in done:
            continue
        way, at, place = [start], [iter(refs[start])], {start: 0}
        while way:
            step = next(at[-1], None)
            if step is None:
                done.add(way[-1])
                del place[way.pop()]
                at.pop()
            elif step in place:
                cycle = way[place[step] :]
                found.setdefault(frozenset(cycle), [*cycle, step])
            elif step in refs and step not in done:
                place[step] = len(way)
                way.append(step)
                at.append(iter(refs[step]))
    return pd.DataFrame({"path": [" → ".join(c) for c in found.values()], "nodes": [sorted(k) for k in found]})


def find_cycles(models: DataFrame) -> DataFrame:
    """(path, nodes): one cycle for each back edge of a depth-first walk in the order of names, each set of nodes once.

    A walk never leaves the connected part that it starts in, so each part of what trimming leaves (nothing, in sound
    projects) is walked by itself, in tasks. The parts are not cut to strongly connected ones: where a walk enters a cycle
    decides how its path reads. A part must fit into a task.
    """
    left = trimmed(models)
    roots = components(left, "dependent", "ref")
    # A reference to itself alone is a part, too.
    parted = left.join(roots, left["dependent"] == roots["node"], "left").select("dependent", "ref", F.coalesce("root", "dependent").alias("part"))
    return by_part(written(parted, "cycles"), walk, "path string, nodes array<string>")


# The hint of a cycle, and how many of its edges it names.
CYCLE_HINT, HINTED = "Remova uma ref() neste loop (candidatas: {}).", 4


def cycle_report(models: DataFrame) -> DataFrame:
    """(path, nodes, cut_edges, hint) of each cycle: the nodes in its order, the edges of which one is to be cut, and a hint that names the first of them."""
    way = F.split("path", " → ")
    edge = F.transform(F.slice(way, 1, F.size(way) - 1), lambda a, i: F.struct(a.alias("from"), F.get(way, i + 1).alias("to")))
    before, after = CYCLE_HINT.split("{}")
    hint = F.concat(F.lit(before), F.array_join(F.transform(F.slice("cut_edges", 1, HINTED), lambda e: F.concat(e["from"], F.lit("→"), e["to"])), ", "), F.lit(after))
    return find_cycles(models).select("path", F.slice(way, 1, F.size(way) - 1).alias("nodes"), edge.alias("cut_edges")).withColumn("hint", hint)


def item_impact(items: DataFrame, models: DataFrame) -> DataFrame:
    """(name, n_impact, impact_text) of each item: what depends on it, or on the base model that it stands for; the text has the first ten by name.

    An item that stands for another reaches what a node with the dependents of both would reach.
    """
    own = items.select("name", F.explode(F.array_compact(F.array("name", "match_name"))).alias("root")).distinct()
    pairs = written(edges(models).select(F.col("ref").alias("src"), F.col("dependent").alias("dst")).distinct(), "pairs")
    item = F.concat(F.lit("item\0"), F.col("name"))
    pairs = written(pairs.unionByName(own.join(pairs, F.col("root") == F.col("src")).select(item.alias("src"), "dst").distinct()), "pairs")
    roots = items.select(item.alias("root")).distinct()
    name = F.substring_index("root", "\0", -1).alias("name")
    counts, first = reach.counts_and_first(pairs, roots)
    counts, first = counts.select(name, F.col("n").alias("n_impact")), first.select(name, F.array_join("names", ", ").alias("first"))
    text = F.when(F.col("first").isNull(), "Ninguém depende deste arquivo").otherwise(F.concat(F.lit("Afeta depois: "), F.col("first")))
    return items.select("name").join(counts, "name", "left").join(first, "name", "left").select("name", F.coalesce("n_impact", F.lit(0)).alias("n_impact"), text.alias("impact_text"))


def order_key(items: DataFrame) -> DataFrame:
    boost = F.when(F.col("table_kind") == "AGGR", 2).when(F.col("table_kind").isin("F", "DIB"), 1).otherwise(0)
    return items.where("pending").select("name", P.layer_rank(F.col("layer")).alias("rank"), boost.alias("boost"))


def behind_cycles(edges: DataFrame) -> DataFrame:
    """(name) of what is on a cycle of the edges (dependent, ref) or depends on one: what is left when references to what has none are taken away again and again."""
    left = written(edges.select("dependent", "ref").distinct(), "order")
    count = left.count()
    while count:
        left = written(left.join(left.select(F.col("dependent").alias("ref")).distinct(), "ref", "left_semi").select("dependent", "ref"), "order")
        before, count = count, left.count()
        if count == before:
            break
    return left.select(F.col("dependent").alias("name")).distinct()


def highest_before(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """keys (name, key) with the greatest key among each node and all that it refers to, in any number of steps, as `top`. The edges (dependent, ref) have no cycle; values are passed on until none changes."""
    top = written(keys.withColumn("top", F.col("key")), "order")
    while True:
        up = edges.join(top.select(F.col("name").alias("ref"), F.col("top").alias("of_ref")), "ref").groupBy(F.col("dependent").alias("name")).agg(F.max("of_ref").alias("of_refs"))
        new = written(top.join(up, "name", "left").select("name", "key", F.greatest("top", F.coalesce("of_refs", "top")).alias("top"), (F.col("of_refs") > F.col("top")).alias("changed")), "order")
        top = new.select("name", "key", "top")
        if new.where("changed").isEmpty():
            return top


def heap_order(part: pd.DataFrame) -> pd.DataFrame:
    """(name, highest, at, blocked) of the items (name, rank, boost, refs) of a part: always the smallest item that is ready goes next.

    at: its place in the part; highest: the greatest (rank, boost, name) so far. Items on or behind a cycle are blocked.
    """
    key_of = {n: (r, b, n) for n, r, b in zip(part["name"], part["rank"].tolist(), part["boost"].tolist(), strict=True)}
    waits, frees = {}, {}
    for n, refs in zip(part["name"], part["refs"], strict=True):
        waits[n] = len(refs)
        for r in refs:
            frees.setdefault(r, []).append(n)
    ready = [key_of[n] for n, k in waits.items() if not k]
    heapify(ready)
    rows, highest = [], ()
    while ready:
        key = heappop(ready)
        highest = max(highest, key)
        rows.append((key[2], {"rank": highest[0], "boost": highest[1], "name": highest[2]}, len(rows), False))
        for n in frees.get(key[2], ()):
            waits[n] -= 1
            if not waits[n]:
                heappush(ready, key_of[n])
    rows += [(n, {"rank": key_of[n][0], "boost": key_of[n][1], "name": n}, 0, True) for n, k in waits.items() if k]
    return pd.DataFrame(rows, columns=["name", "highest", "at", "blocked"])


def topo_order(items: DataFrame, models: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(ord, name, blocked): pending items so that references come first and, among what is ready, the smallest (layer rank, kind, name); what is on or behind a cycle comes last, by the same key, as blocked.

    Connected parts of the pending items are ordered by themselves, each with a heap. Always taking the smallest of the parts'
    next items merges them by the greatest key that each part has had so far. Parts of more than part_rows
    items and references go by rounds.
    """
    pending = written(order_key(items).select("name", F.struct("rank", "boost", "name").alias("key")), "order")
    names = lambda c: pending.select(F.col("name").alias(c))
    inner = written(edges(models).join(names("dependent"), "dependent", "left_semi").join(names("ref"), "ref", "left_semi").select("dependent", "ref").distinct(), "order")
    roots = components(inner, "dependent", "ref").withColumnRenamed("node", "name")
    refs = inner.groupBy(F.col("dependent").alias("name")).agg(F.collect_list("ref").alias("refs"))
    nodes_ = pending.join(roots, "name", "left").join(refs, "name", "left").select("name", "key", F.coalesce("root", "name").alias("part"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    small, large = sized(written(nodes_, "order"), part_rows)
    kind = pending.schema["key"].dataType.simpleString()
    placed = by_part(small.select("name", "key.rank", "key.boost", "refs", "part"), heap_order, f"name string, highest {kind}, at int, blocked boolean")
    # Within a part the place decides, written as a key.
    place = F.struct(F.col("at").alias("rank"), F.lit(0).alias("boost"), F.lit("").alias("name")).cast(kind)
    placed = placed.select("name", F.array("highest", place).alias("place"), "blocked")
    own = written(large.select("name", "key"), "order")
    if not own.isEmpty():
        within = inner.join(own.select(F.col("name").alias("dependent")), "dependent", "left_semi")
        placed = placed.unionByName(places_by_rounds(own, written(within, "order")))
    return numbered(placed, ["blocked", "place"], "ord", "order").select(F.col("ord").cast("int").alias("ord"), "name", "blocked")


def places_by_rounds(pending: DataFrame, inner: DataFrame) -> DataFrame:
    """(name, place, blocked) of the items (name, key) and the references among them: in the order of places, always the smallest item that is ready comes next.

    That is the order of each item's greatest key among itself and all before it: an item waits for the one with that key, and is then
    smaller than all else that waits. Items of the same greatest key are the one that has it, then the others in the order
    that the same rule gives among them alone. So an item's place is a list of keys, found in as many turns as
    references go from a later to an earlier key one after another on a way.
    """
    blocked = written(behind_cycles(inner), "order")
    left = pending.join(blocked, "name", "left_anti").withColumn("place", F.array().cast(f"array<{pending.schema['key'].dataType.simpleString()}>"))
    open_edges = inner.join(blocked, inner["dependent"] == blocked["name"], "left_anti")
    done = pending.join(blocked, "name", "left_semi").select("name", F.array("key").alias("place"), F.lit(True).alias("blocked"))
    while True:
        top = highest_before(left.select("name", "key"), open_edges)
        placed = written(left.join(top.select("name", "top"), "name").select("name", "key", F.concat("place", F.array("top")).alias("place"), (F.col("top") == F.col("key")).alias("first")), "order")
        done = done.unionByName(placed.where("first").select("name", "place", F.lit(False).alias("blocked")))
        left = placed.where("not first").drop("first")
        if left.isEmpty():
            return done
        # Only references within the rest of a group still count.
        at = lambda c: left.select(F.col("name").alias(c), F.col("place").alias(f"{c}_place"))
        open_edges = written(open_edges.join(at("dependent"), "dependent").join(at("ref"), "ref").where("dependent_place = ref_place").select("dependent", "ref"), "order")


def impact(models: DataFrame) -> DataFrame:
    """(name, n_downstream, n_direct, first): how many nodes each model affects, and the first ten by name."""
    pairs = written(edges(models).select(F.col("ref").alias("src"), F.col("dependent").alias("dst")).distinct(), "pairs")
    roots = models.select(F.col("name").alias("root"))
    counts, first = reach.counts_and_first(pairs, roots)
    counts, first = counts.select(F.col("root").alias("name"), F.col("n").alias("n_downstream")), first.select(F.col("root").alias("name"), F.array_join("names", ", ").alias("first"))
    direct = pairs.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("n_direct"))
    out = models.select("name").join(counts, "name", "left").join(direct, "name", "left").join(first, "name", "left")
    return out.select("name", F.coalesce("n_downstream", F.lit(0)).alias("n_downstream"), F.coalesce("n_direct", F.lit(0)).alias("n_direct"), F.coalesce("first", F.lit("")).alias("first"))


# How many flow chains start, how far they go, and the word for each status.
CHAIN_SEEDS, CHAIN_HOPS = 12, 6
CHAIN_WORDS = {"NOVO": "criar", "ALTERADO": "atualizar", "IGUAL": "ok", "REMOVIDO": "remover", "RENOMEADO": "renomear?"}


def flow_chains(items: DataFrame, models: DataFrame) -> DataFrame:
    """(ord, chain) from the first new or changed source, sample, staging or seed models (else the first five new or changed) along the first dependent that is an item."""
    words = F.create_map(*[F.lit(x) for pair in CHAIN_WORDS.items() for x in pair])
    listed = items.where("status in ('NOVO', 'ALTERADO')")
    by = Window.orderBy((F.col("status") == "NOVO").cast("int"), P.layer_rank(F.col("layer")), "name")
    early = listed.where(F.col("layer").isin("source", "sample", "staging", "seed"))
    seeds = early if not early.isEmpty() else listed.orderBy((F.col("status") == "NOVO").cast("int"), P.layer_rank(F.col("layer")), "name").limit(5)
    first = seeds.orderBy((F.col("status") == "NOVO").cast("int"), P.layer_rank(F.col("layer")), "name").limit(CHAIN_SEEDS)
    chain = first.select((F.row_number().over(by) - 1).alias("ord"), F.col("name").alias("at"), F.array("name").alias("names"))
    step = edges(models).join(items.select(F.col("name").alias("dependent")), "dependent", "left_semi").groupBy(F.col("ref").alias("at")).agg(F.min("dependent").alias("next"))
    for _ in range(CHAIN_HOPS):
        chain = chain.join(step, "at", "left").select("ord", F.coalesce("next", F.lit("")).alias("at"), F.when(F.col("next").isNull(), F.col("names")).otherwise(F.concat("names", F.array("next"))).alias("names"))
    status = items.select("name", "status")
    parts = chain.select("ord", F.posexplode("names").alias("k", "name")).join(status, "name", "left").select("ord", "k", F.concat("name", F.lit(" ("), F.coalesce(F.try_element_at(words, F.col("status")), F.lit("ok")), F.lit(")")).alias("part"))
    return parts.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("p")).select("ord", F.array_join(F.transform("p", lambda x: x["part"]), " → ").alias("chain"))
