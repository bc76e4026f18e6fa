import random

from spanloom.operators import diff, graph, reach, views

PAIRS = "src string, dst string"


def reached(pairs):
    """By each node all that it reaches, walked from each by itself."""
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    out = {}
    for root in to:
        seen, todo = set(), [root]
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[root] = seen
    return out


def test_counts_and_first_names_with_cycles(spark):
    rnd = random.Random(4)
    names = [f"n{i}" for i in range(700)]  # two blocks of roots
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(650)] + [("n1", "n1"), ("x", "y"), ("y", "x"), (None, "x"), ("x", None)]
    pairs += [("hub", n) for n in names[:300]] + pairs[:20]
    want = reached([p for p in pairs if None not in p])
    table = spark.createDataFrame(pairs, PAIRS)
    roots = spark.createDataFrame([(n,) for n in [*names, "x", "y", "hub", "nowhere"]], "root string")
    assert {r["root"]: r["n"] for r in reach.counts(table, roots).collect()} == {k: len(v) for k, v in want.items()}
    assert {r["root"]: r["names"] for r in reach.first_names(table, roots, 7).collect()} == {k: sorted(v)[:7] for k, v in want.items()}


def steps(pairs):
    """By each node the least number of steps to all that it reaches, level by level from each by itself."""
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    out = {}
    for root in to:
        dist, level, k = {}, to[root], 1
        while level:
            dist |= dict.fromkeys(level, k)
            level, k = {b for a in level for b in to.get(a, ()) if b not in dist}, k + 1
        out[root] = dist
    return out


def test_nearest_and_farthest_with_cycles(spark):
    rnd = random.Random(9)
    names = [f"n{i}" for i in range(700)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(900)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("x", "y"), ("y", "x"), ("n1", "n1"), (None, "x")]
    pairs += [("hub", n) for n in names[:300]] + pairs[:20]
    want = steps([p for p in pairs if None not in p])
    roots = spark.createDataFrame([(n,) for n in [*want, "nowhere"]], "root string")
    table = spark.createDataFrame(pairs, PAIRS)
    for far in (False, True):
        rows = {r["root"]: (r["n"], r["names"]) for r in reach.by_distance(table, roots, 5, farthest=far).collect()}
        sign = -1 if far else 1
        assert rows == {k: (len(v), sorted(v, key=lambda x: (sign * v[x], x))[:5]) for k, v in want.items()}
    assert reach.by_distance(table.where("false"), roots).count() == 0


def test_counts_of_empty_graphs(spark):
    none, roots = spark.createDataFrame([], PAIRS), spark.createDataFrame([("a",)], "root string")
    assert reach.counts(none, roots).count() == reach.first_names(none, roots).count() == 0
    assert reach.counts(none, roots.where("false")).count() == 0


def test_item_impact_of_what_stands_for_another(spark):
    model = "name string, layer string, type string, refs array<string>, sources array<struct<schema: string, table: string>>"
    models = spark.createDataFrame([("a", "staging", "model", [], []), ("b", "staging", "model", [], []), ("c", "mart", "model", ["a", "b"], []), ("d", "mart", "model", ["c"], []), ("e", "mart", "model", ["b"], [])], model)
    items = spark.createDataFrame([("a", None), ("new", "b"), ("d", None)], "name string, match_name string")
    got = {r["name"]: (r["n_impact"], r["impact_text"]) for r in graph.item_impact(items, models).collect()}
    assert got == {"a": (2, "Afeta depois: c, d"), "new": (3, "Afeta depois: c, d, e"), "d": (0, "Ninguém depende deste arquivo")}


def test_compare_and_focus_order(spark):
    rows = [("new", "NOVO", 1, True), ("gone", "REMOVIDO", 0, False), ("b", "IGUAL", 3, False), ("a", "ALTERADO", 3, True), ("s", "IGUAL", 1, False), ("as", "RENOMEADO", 0, True), ("away", "REMOVIDO", 4, False)]
    items = spark.createDataFrame(rows, "name string, status string, layer_order int, pending boolean")
    got = diff.compare_order(items).orderBy("item_ord").collect()
    assert [(r["item_ord"], r["name"]) for r in got] == list(enumerate(["s", "a", "b", "as", "new", "away", "gone"]))
    order = spark.createDataFrame([("a", 0), ("as", 1)], "name string, ord int")
    got = views.focus_order(items, order).orderBy("pos").collect()
    assert [(r["pos"], r["name"]) for r in got] == [(1, "as"), (2, "a"), (3, "new")]
    assert diff.compare_order(items.where("false")).count() == 0


def test_counts_both_ways_with_cycles_that_touch(spark):
    rnd = random.Random(11)
    names = [f"n{i}" for i in range(60)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(70)] + [("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("w", "z"), ("s", "s"), ("a", "b"), ("b", "c"), ("a", "c")]
    down, up = reached(pairs), reached([(b, a) for a, b in pairs])
    got = {r["node"]: (r["n_up"], r["n_down"]) for r in reach.counts_both_ways(spark.createDataFrame(pairs, PAIRS)).collect()}
    assert got == {n: (len(up.get(n, ())), len(down.get(n, ()))) for n in {*up, *down}}


def test_reach_lists_are_not_read_again(spark, monkeypatch):
    """A chain of 6: every pair is found once, so all that the rounds write of it grows with the pairs, not with rounds times pairs."""
    wrote, own = [], reach.written
    monkeypatch.setattr(reach, "written", lambda df, tag: (out := own(df, tag), wrote.append((tag, out.count())))[0])
    chain = spark.createDataFrame([(f"c{k:02d}", f"c{k + 1:02d}") for k in range(6)], PAIRS)
    roots = spark.createDataFrame([(f"c{k:02d}",) for k in range(7)], "root string")
    assert {r["n"] for r in reach.counts(chain, roots).collect()} == set(range(1, 7))
    assert sum(n for tag, n in wrote if tag == "reach") == 6 * 7 // 2


MODEL = "name string, layer string, type string, refs array<string>, sources array<struct<schema: string, table: string>>"


def test_views_list_each_pair_once(spark, monkeypatch):
    """A chain of 9 models, three of them roots: all rows that rounds write are the pairs with a root, whatever the number of rounds."""
    wrote, own = [], reach.written

    def counted(df, tag):
        out = own(df, tag)
        wrote.append((tag, out.count()))
        return out

    monkeypatch.setattr(reach, "written", counted)
    monkeypatch.setattr(graph, "written", counted)
    names = [f"c{k}" for k in range(9)]
    models = spark.createDataFrame([(n, "staging", "model", names[k - 1 : k] if k else ["gone"], []) for k, n in enumerate(names)], MODEL)
    roots = ["c1", "c4", "c8"]
    got = {r["root"]: (r["n_up"], r["n_down"]) for r in views.ego(models, spark.createDataFrame([(r,) for r in [*roots, "alone"]], "root string")).collect()}
    assert got == {"c1": (2, 7), "c4": (5, 4), "c8": (9, 0), "alone": (0, 0)}
    assert sum(n for tag, n in wrote if tag == "reach") == 2 + 7 + 5 + 4 + 9
    wrote.clear()
    items = spark.createDataFrame([(r, None) for r in roots], "name string, match_name string")
    rows = views.macro_members(items, models, items.select(items["name"].alias("focus"))).rows.collect()
    assert len(rows) == len({(r["focus"], r["id"]) for r in rows}) == 27 + 3
    assert sum(n for tag, n in wrote if tag == "reach") == 27


def test_levels_send_nothing_through_the_driver(spark, monkeypatch):
    """What is ready in a round is not broadcast: it grows with the graph, and there are as many rounds as levels."""
    plans, own = [], reach.written

    def planned(df, tag):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return own(df, tag)

    monkeypatch.setattr(reach, "written", planned)
    monkeypatch.setattr(graph, "written", planned)
    refs = {"a": [], "b": ["a"], "c": ["b", "a"], "d": ["gone"], "x": ["y"], "y": ["x", "c"], "z": ["x"]}
    models = spark.createDataFrame([(n, "staging", "model", r, []) for n, r in refs.items()], MODEL)
    assert {r["name"]: r["level"] for r in graph.levels(models).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    assert plans and not any("Broadcast" in p for p in plans)


def test_edges_of_views_are_lists(spark, monkeypatch):
    """Cycles, shortcuts past a focus, and a model that is stood for, against sets; in slices of 3 foci, and in one. On a chain no round writes more rows than there are nodes."""
    rnd = random.Random(6)
    names = [f"m{k:02d}" for k in range(26)]
    refs = {n: sorted({rnd.choice(names[:k]) for _ in range(rnd.randrange(4))} | ({"gone"} if k % 9 == 4 else set())) if k else [] for k, n in enumerate(names)}
    for a, b in (("m05", "m09"), ("m09", "m05"), ("m20", "m21"), ("m21", "m20"), ("m21", "m22"), ("m22", "m20"), ("m13", "m13")):
        refs[a] = sorted({*refs[a], b})
    refs["m25"] = []
    models = spark.createDataFrame([(n, "staging", "model", r, []) for n, r in refs.items()], MODEL)
    stands_for = {"m07": "m24", "m11": "m25", "m21": "m03"}
    foci = [n for k, n in enumerate(names) if k % 3 or n in stands_for]
    item = "name string, match_name string, status string, policy_action string, add_items array<struct<kind: string, name: string>>"
    items = spark.createDataFrame([(n, stands_for.get(n), "NOVO" if n == "m20" else "ALTERADO", "append", [("referência", refs[n][0])] if refs[n] else []) for n in foci], item)
    edges = [(r, n) for n, rs in refs.items() for r in rs]
    down, up = reached(edges), reached([(b, a) for a, b in edges])
    want = set()
    for f in foci:
        view = {f, *down.get(f, ()), *up.get(f, ()), stands_for.get(f, f)}
        want |= {(f, a, b, "new" if b == "m20" or (b in foci and a == refs[b][0]) else "exist") for a, b in edges if a in view and b in view}
    roots = items.select(items["name"].alias("focus"))
    for size in (3, reach.SLICE):
        monkeypatch.setattr(reach, "SLICE", size)
        got = [tuple(r) for r in views.macro_edges(items, models, roots).select("focus", "source", "target", "kind").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    wrote, own = [], reach.written

    def counted(df, tag):
        out = own(df, tag)
        wrote.append((tag, out.count()))
        return out

    monkeypatch.setattr(reach, "written", counted)
    monkeypatch.setattr(views, "written", counted)
    names = [f"c{k}" for k in range(9)]
    models = spark.createDataFrame([(n, "staging", "model", names[k - 1 : k] if k else [], []) for k, n in enumerate(names)], MODEL)
    items = spark.createDataFrame([(n, None, "ALTERADO", "append", []) for n in names], item)
    assert views.macro_edges(items, models, items.select(items["name"].alias("focus"))).count() == 9 * 8
    assert sum(n for tag, n in wrote if tag in ("reach", "views")) == 2 * 9
