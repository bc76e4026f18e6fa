import random
import sys

import pandas as pd

from spanloom.operators import graph, match, parts
from spanloom.plans import tables

PAIRS = "name string, match_name string, score double"


def slow_greedy(pairs):
    used, out = set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if not used & {("a", a), ("b", b)}:
            used |= {("a", a), ("b", b)}
            out.add((a, b, s))
    return out


def test_matching_by_parts_and_by_rounds(spark):
    rnd = random.Random(8)
    pairs = [(f"w{i}", f"w{rnd.randrange(60)}", rnd.randrange(9) / 8) for i in range(60) for _ in range(rnd.randrange(3))]
    pairs = list({p[:2]: p for p in pairs}.values())  # names of both sides may be the same
    df = spark.createDataFrame(pairs, PAIRS)
    want = slow_greedy(pairs)
    for part_rows in (0, 4, 1_000):
        assert {tuple(r) for r in match.one_to_one(df, part_rows).collect()} == want
    assert match.one_to_one(df.where("false")).count() == 0


def test_a_long_chain_of_preferences_takes_few_rounds(spark, monkeypatch):
    """w0-b0 < b0-w1 < w1-b1 < ...: each pair is only decided by the next, so going by the best pairs of each round takes a round for each two."""
    chain = [(f"w{(i + 1) // 2:04d}", f"b{i // 2:04d}", i / 4_000) for i in range(2_000)]
    seen = []
    own = tables.written
    for module in (match, parts):
        monkeypatch.setattr(module, "written", lambda df, tag: seen.append(tag) or own(df, tag))
    got = {tuple(r) for r in match.one_to_one(spark.createDataFrame(chain, PAIRS)).collect()}
    assert got == slow_greedy(chain) and len(got) == 1_000
    assert len(seen) < 60


def slow_cycles(edges):
    """The same walk, by recursion over the whole graph."""
    refs = {}
    for a, b in sorted(set(edges)):
        refs.setdefault(a, []).append(b)
    found, done = {}, set()

    def visit(n, way):
        for r in refs.get(n, ()):
            if r in way:
                cycle = way[way.index(r) :]
                found.setdefault(frozenset(cycle), " → ".join([*cycle, r]))
            elif r not in done:
                visit(r, [*way, r])
        done.add(n)

    for n in sorted(refs):
        if n not in done:
            visit(n, [n])
    return sorted(found.values())


def graph_of(spark, edges):
    refs = {}
    for a, b in edges:
        refs.setdefault(a, set()).add(b)
    rows = [(n, "marts", "model", sorted(refs.get(n, ())), []) for n in sorted({x for e in edges for x in e})]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["name", "layer", "type", "refs", "sources"]), "name string, layer string, type string, refs array<string>, sources array<struct<schema: string, table: string>>")


def test_cycles_against_recursion(spark):
    rnd = random.Random(2)
    for _ in range(2):
        edges = {(f"{g}{rnd.randrange(9)}", f"{g}{rnd.randrange(9)}") for g in "abc" for _ in range(11)} | {("z", "z"), ("y", "z")}
        got = [r["path"] for r in graph.find_cycles(graph_of(spark, edges)).collect()]
        assert sorted(got) == slow_cycles(edges) and "z → z" in got


def test_many_cycles_of_many_edges(spark):
    """100,000 edges: cycles of 4 to 12 models each, one of 20,000, and shortcuts."""
    rnd, edges, at = random.Random(6), [], 0
    while at < 70_000:
        n = rnd.randrange(4, 13)
        edges += [(f"n{at + k:06d}", f"n{at + (k + 1) % n:06d}") for k in range(n)]
        at += n
    edges += [(f"long{k:05d}", f"long{(k + 1) % 20_000:05d}") for k in range(20_000)]
    edges += [(f"n{k:06d}", f"n{k + 1:06d}") for k in rnd.sample(range(70_000), 10_000)]  # within a cycle, or on to the next
    sys.setrecursionlimit(100_000)
    got = graph.find_cycles(graph_of(spark, edges)).collect()
    long = [r for r in got if r["nodes"][0].startswith("long")]
    assert len(long) == 1 and len(long[0]["nodes"]) == 20_000
    short = {tuple(e) for e in edges if e[0].startswith("n")}
    for r in got:
        way = r["path"].split(" → ")
        assert way[0] == way[-1] and sorted(way[:-1]) == r["nodes"]
        assert r in long or all(e in short for e in zip(way, way[1:], strict=False))
    assert len(got) > 8_000


def test_order_by_parts_and_by_rounds(spark):
    rnd = random.Random(9)
    names = [f"n{i:02d}" for i in rnd.sample(range(100), 40)]
    edges = {(names[k], rnd.choice(names[:k])) for k in range(1, 40) if rnd.random() < 0.7} | {("x1", "x2"), ("x2", "x1"), ("x3", "x1"), ("s", "s")}
    models = graph_of(spark, edges | {(n, "outside") for n in names})
    layer = {n: rnd.choice(["staging", "intermediate", "mart", "aggregate"]) for n in [*names, "x1", "x2", "x3", "s"]}
    items = spark.createDataFrame([(n, v, rnd.choice([None, "F", "AGGR"]), True) for n, v in layer.items()] + [("outside", "mart", None, False)], "name string, layer string, table_kind string, pending boolean")
    key = {r["name"]: (r["rank"], r["boost"], r["name"]) for r in graph.order_key(items).collect()}
    waits, expected = {n: {b for a, b in edges if a == n} for n in layer}, []
    while ready := [key[n] for n, w in waits.items() if not w]:
        expected.append(min(ready)[2])
        del waits[expected[-1]]
        for w in waits.values():
            w.discard(expected[-1])
    want = [(n, False) for n in expected] + [(k[2], True) for k in sorted(key[n] for n in waits)]
    assert {n for n, blocked in want if blocked} == {"x1", "x2", "x3", "s"}
    for part_rows in (0, 3, 1_000):
        assert [(r["name"], r["blocked"]) for r in graph.topo_order(items, models, part_rows).orderBy("ord").collect()] == want
    assert graph.topo_order(items.where("false"), models).count() == 0
