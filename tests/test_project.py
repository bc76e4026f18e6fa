import random
import statistics

import pytest

from spanloom.operators import catalog, diff, graph, match, report, rules, verify, views
from spanloom.plans import queries
from spanloom.plans.tables import written
from spanloom.sources import synth

FILES = "project string, path string, text string, scan_ord long"


def models(spark, project, texts):
    return catalog.parse_sql_files(spark.createDataFrame([(project, f"d/models/{n}.sql", t, i) for i, (n, t) in enumerate(texts.items())], FILES))


def refs(*names):
    return "select id_key from " + " join ".join(f"{{{{ ref('{n}') }}}}" for n in names) if names else "select id_key from t"


def test_statuses_policy_and_verification(spark):
    base = models(spark, "base", {"a": "select x from t", "b": "select x from t", "c": "select x, y from t", "gone": "select x from t"})
    work = models(spark, "workspace", {"a": "select x from t", "b": "select x, id_z from t", "c": "select x from t where x > 1", "new": "select x from t"})
    items = diff.with_policy(diff.compare(base, work, detect_removed=True))
    got = {r["name"]: (r["status"], r["policy_action"], r["add_count"]) for r in items.collect()}
    assert got == {"a": ("IGUAL", "exists", 0), "b": ("ALTERADO", "append", 1), "c": ("ALTERADO", "skip", 0), "new": ("NOVO", "create", 1), "gone": ("REMOVIDO", "review", 0)}
    b = items.where("name = 'b'").first()
    assert b["diff"] == ["+ coluna id_z adicionada", "~ conteúdo do arquivo alterado"] and tuple(b["add_items"][0]) == ("coluna", "id_z", "id", "integer")
    assert {r["name"]: r["result"] for r in verify.check(items, base).collect()} == {"b": "missing", "new": "missing"}
    assert {r["name"]: r["result"] for r in verify.check(items, work).collect()} == {"b": "ok", "new": "ok"}
    assert verify.totals(verify.check(items, work)).first()["complete"]


def test_alias_counts_all_items(spark):
    base, work = models(spark, "base", {"old": "select x from t"}), models(spark, "workspace", {"z": "select x, y from t"})
    row = diff.with_policy(diff.compare(base, work, aliases=diff.alias_table(spark, {"z": "old"}))).first()
    assert (row["status"], row["match_name"], row["add_count"]) == ("ALTERADO", "old", 2)


def test_one_to_one_is_greedy(spark):
    rng = random.Random(3)
    for _ in range(3):
        pairs = [(f"w{i}", f"b{j}", rng.randrange(8) / 8) for i in range(6) for j in range(6) if rng.random() < 0.6]
        used, expected = set(), set()
        for w, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
            if not used & {w, b}:
                used |= {w, b}
                expected.add((w, b))
        df = spark.createDataFrame(pairs, "name string, match_name string, score double")
        assert {(r["name"], r["match_name"]) for r in match.one_to_one(df).collect()} == expected


def test_candidates_lose_nothing(spark):
    rng = random.Random(5)
    text = lambda: "select " + ", ".join(rng.sample(["a1", "b1", "c1", "d1"], 2)) + " from " + rng.choice(["{{ ref('p') }}", "{{ ref('q') }}", "t"])
    work = models(spark, "workspace", {f"stg_pedido{i}": text() for i in range(8)} | {"stg_x": "create x"})
    base = models(spark, "base", {f"stg_pedidos{i}": text() for i in range(8)} | {"stg_y": "create y"})
    pairs = lambda c: {(r["name"], r["match_name"], round(r["score"], 9)) for r in match.scored(c).collect()}
    assert pairs(match.candidates(work, base)) == pairs(match.candidates(work, base, 0.4)) != set()
    assert ("stg_x", "stg_y") in {p[:2] for p in pairs(match.candidates(work, base))}  # no structure on both sides


def test_candidates_by_shapes_of_names(spark):
    """Names of the same letters are compared once, and none of their pairs is lost."""
    rng = random.Random(6)
    text = lambda k: f"select a1, b1, {rng.choice(['c1', 'd1'])} from {{{{ ref('{k}{rng.randrange(1000)}') }}}}"
    work = models(spark, "workspace", {f"stg_{rng.choice(['', 'v'])}m{i}": text("p") for i in rng.sample(range(100, 999), 60)})
    base = models(spark, "base", {f"{rng.choice(['stg_', 'stg_x', 'src_'])}m{i}": text("q") for i in rng.sample(range(100, 999), 80)})
    pairs = lambda c: {(r["name"], r["match_name"], round(r["score"], 9)) for r in match.scored(c).collect()}
    found = match.candidates(work, base)
    assert pairs(found) == pairs(match.candidates(work, base, 0.4)) != set()
    assert found.count() == found.select("w_name", "b_name").distinct().count() < work.count() * base.count()
    shapes = match.shaped(match.side(work, "w"), "w").select("w_shape").distinct().count()
    assert 1 < shapes < work.count()


def test_cycle_and_order(spark):
    work = models(spark, "workspace", {"a": refs("c"), "b": refs("a"), "c": refs("b"), "d": refs("a"), "e": refs(), "f": refs("e")})
    items = diff.with_policy(diff.compare(models(spark, "base", {"zz": refs()}), work))
    assert sorted(r["name"] for r in graph.cycle_nodes(work).collect()) == ["a", "b", "c"]
    assert [r["path"] for r in graph.find_cycles(work).collect()] == ["a → c → b → a"]
    order = [(r["name"], r["blocked"]) for r in graph.topo_order(items, work).orderBy("ord").collect()]
    assert order == [("e", False), ("f", False), ("a", True), ("b", True), ("c", True), ("d", True)]
    meta = views.order_meta(items, work).first()
    assert (meta["safe_prefix"], meta["blocked_by_cycle"], meta["cycle_count"]) == ("e,f", "a,b,c,d", 1)
    assert {r["name"]: r["level"] for r in graph.levels(work).collect()} == {"e": 0, "f": 1}
    reach = {(r["root"], r["node"]): r["dist"] for r in graph.downstream(work, spark.createDataFrame([("a",)], "root string")).collect()}
    assert reach == {("a", "b"): 1, ("a", "d"): 1, ("a", "c"): 2, ("a", "a"): 3}


def test_rules(spark):
    base = models(spark, "base", {"stg_a": refs(), "stg_b": refs("src_q")})
    work = models(spark, "workspace", {"stg_new": refs("stg_a", "nowhere"), "Bad-Name": refs("stg_new")})
    items = diff.with_policy(diff.compare(base, work))
    every = catalog.merged(base, work)
    got = {(r["code"], r["model"], r["detail"]) for r in rules.validate(items, every, base).collect()}
    assert {("BROKEN_REF", "stg_new", "nowhere"), ("DEAD_MODEL", "Bad-Name", ""), ("NAME", "Bad-Name", "case"), ("NAME", "Bad-Name", "separator")} <= got
    empty = items.limit(0)
    assert rules.validate(empty, every.limit(0), base.limit(0)).count() == 0


def test_registered_closures_start_from_all_nodes(spark, tmp_path):
    spark.range(1, 61).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    every = synth.merged(spark, str(tmp_path))
    names = {r["name"] for r in every.collect()}
    below, above = {}, {}
    for r in graph.edges(every).collect():
        below.setdefault(r["ref"], set()).add(r["dependent"])
        above.setdefault(r["dependent"], set()).add(r["ref"])
    sources = {x for x in below if x.startswith("source.")}

    def walk(steps, roots):
        found = set()
        for root in roots:
            new, dist, seen = steps.get(root, set()), 1, set()
            while new := new - seen:
                found |= {(root, n, dist) for n in new}
                seen |= new
                new, dist = set().union(*(steps.get(n, set()) for n in new)), dist + 1
        return found

    q = queries.queries()
    down, up = walk(below, names | sources), walk(above, names)
    assert sources and {tuple(r) for r in q["downstream_all"](spark, str(tmp_path)).collect()} == down
    assert {tuple(r) for r in q["upstream_all"](spark, str(tmp_path)).collect()} == up
    got = {r["root"]: (r["n_up"], r["n_down"]) for r in q["ego_view_all"](spark, str(tmp_path)).collect()}
    assert got == {n: (sum(p[0] == n for p in up), sum(p[0] == n for p in down)) for n in names | sources}


def test_warnings_all_has_cycles_and_undeclared_sources(spark, tmp_path):
    d = str(tmp_path)
    spark.range(1, 241).withColumnRenamed("id", "p_partkey").write.parquet(f"{d}/part.parquet")
    got = [tuple(r[c] for c in ("severity", "label", "code", "model", "detail")) for r in queries.queries()["warnings_all"](spark, d).orderBy("ord").collect()]
    less = [tuple(r[c] for c in ("severity", "label", "code", "model", "detail")) for r in queries.queries()["warnings_sorted"](spark, d).orderBy("ord").collect()]
    assert [r for r in got if r[2] not in ("DAG_CYCLE", "UNDECLARED_SOURCE")] == less
    undeclared = {
        (r["name"], f"source.{x['schema']}.{x['table']}")
        for r in synth.items(spark, d).collect()
        if r["status"] != "IGUAL" and (r["policy_action"] in ("create", "append") or r["status"] == "NOVO")
        for x in r["sources"]
        if int(x["table"][1:]) >= synth.DECLARED
    }
    assert undeclared and {r[3:] for r in got if r[2] == "UNDECLARED_SOURCE"} == undeclared
    refs = {}
    for r in graph.edges(synth.merged(spark, d)).collect():
        refs.setdefault(r["dependent"], set()).add(r["ref"])
    cycles = [r for r in got if r[2] == "DAG_CYCLE"]
    assert cycles and got[0][0] == "critical" and {r[0] for r in cycles} == {"critical"}
    seen = set()
    for *_, model, path in cycles:
        way = path.split(" → ")
        assert way[0] == way[-1] and model == min(way) and all(b in refs[a] for a, b in zip(way, way[1:], strict=False))
        seen |= set(way)

    def returns(node):
        new, reached = set(refs.get(node, ())), set()
        while new := new - reached:
            reached |= new
            new = set().union(*(refs.get(n, ()) for n in new))
        return node in reached

    assert seen <= {n for n in refs if returns(n)} and len(got) == len(less) + len(cycles) + len(undeclared)


def test_warnings_are_numbered_without_one_task_for_all(spark, tmp_path):
    spark.range(1, 241).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.queries()["warnings_sorted"](spark, str(tmp_path))
    rows = found.orderBy("ord").collect()
    rank = {"critical": 0, "warning": 1, "info": 2}
    assert [r["ord"] for r in rows] == list(range(1, len(rows) + 1))
    assert [(rank.get(r["severity"], 3), r["model"]) for r in rows] == sorted((rank.get(r["severity"], 3), r["model"]) for r in rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Window" in x and "severity" in x] and "row_number" not in plan


@pytest.mark.parametrize("one_sort", [500_000, 5])
def test_lanes_against_a_plain_loop(spark, monkeypatch, one_sort):
    monkeypatch.setattr(views, "ONE_SORT", one_sort)
    rng = random.Random(11)
    layers = ["source", "staging", "mart", "other"]
    nodes = {f"n{i:02d}": rng.choice(layers) for i in range(40)} | {"m1": "macro"}
    edges = {(rng.choice(list(nodes)), rng.choice(list(nodes))) for _ in range(70)}
    place = {n: sorted(x for x in nodes if nodes[x] == layer).index(n) for n, layer in nodes.items() if layer != "macro"}
    for turn in range(6):
        for layer in layers[1:] if turn % 2 == 0 else layers[-2::-1]:
            near = {n: [place[a] for a, b in edges if b == n and a in place] if turn % 2 == 0 else [place[b] for a, b in edges if a == n and b in place] for n in nodes if nodes[n] == layer}
            middle = {n: statistics.median(at) if at else place[n] for n, at in near.items()}
            place |= {n: k for k, n in enumerate(sorted(middle, key=lambda n: (middle[n], n)))}
    got = views.lanes(spark.createDataFrame(list(nodes.items()), "id string, layer string"), spark.createDataFrame(list(edges), "source string, target string"))
    assert {r["id"]: r["lane"] for r in got.collect()} == place | {"m1": 0}


def test_order_takes_the_smallest_that_is_ready(spark):
    """Against a heap, where references go to earlier and later layers alike."""
    rng = random.Random(4)
    layers = ["staging", "intermediate", "marts", "aggregate"]
    names = [f"n{i:02d}" for i in range(45)]
    refs_of = {n: rng.sample(names[:k], min(k, rng.randrange(3))) for k, n in enumerate(rng.sample(names, len(names)))}
    refs_of = {n: [r for r in rs if r != n and r in list(refs_of)[: list(refs_of).index(n)]] for n, rs in refs_of.items()}
    refs_of["n00"] = [*refs_of["n00"], "n01"]
    refs_of["n01"] = [*refs_of["n01"], "n00"]  # a cycle
    where = {n: rng.choice(layers) for n in names}
    work = catalog.parse_sql_files(spark.createDataFrame([("workspace", f"d/models/{where[n]}/{n}.sql", refs(*refs_of[n]), i) for i, n in enumerate(names)], FILES))
    items = diff.with_policy(diff.compare(models(spark, "base", {"zz": refs()}), work))
    key = {r["name"]: (r["rank"], r["boost"], r["name"]) for r in graph.order_key(items).collect()}
    waits, expected = {n: set(rs) for n, rs in refs_of.items()}, []
    while ready := [key[n] for n, w in waits.items() if not w]:
        expected.append(min(ready)[2])
        del waits[expected[-1]]
        for w in waits.values():
            w.discard(expected[-1])
    got = [(r["name"], r["blocked"]) for r in graph.topo_order(items, work).orderBy("ord").collect()]
    assert got == [(n, False) for n in expected] + [(k[2], True) for k in sorted(key[n] for n in waits)] and len(waits) >= 2 and len(expected) > 10


def test_views_around_open_items(spark):
    base = models(spark, "base", {"a": refs(), "old": refs("a"), "gone": refs("a"), "far": refs("old", "lost")})
    work = models(spark, "workspace", {"a": refs(), "z": refs("a") + " where x = 1", "n": refs("z", "a"), "far": refs("old", "lost", "n")})
    items = written(diff.with_policy(diff.compare(base, work, aliases=diff.alias_table(spark, {"z": "old"}), detect_removed=True)), "items")
    base, every = written(base, "base"), written(catalog.merged(base, work), "models")
    nodes, edges, heads = views.macro_views(items, every, base)
    got = {r["focus"]: (r["mode"], r["n_recompile"], r["recompile"]) for r in heads.collect()}
    assert got == {"n": ("create", 1, ["far"]), "z": ("append", 2, ["n", "far"]), "far": ("append", 0, [])}
    shown = {r["id"]: (r["visual"], r["origin"], r["status"], r["policy_action"]) for r in nodes.where("focus = 'z'").collect()}
    assert shown == {
        "a": ("exist", "base", "IGUAL", "exists"),
        "z": ("add", "workspace", "ALTERADO", "append"),
        "n": ("new", "workspace", "NOVO", "create"),
        "far": ("add", "both", "ALTERADO", "append"),
        "old": ("exist", "base", "IGUAL", "exists"),
    }
    assert {(r["source"], r["target"]): r["kind"] for r in edges.where("focus = 'z'").collect()} == {("a", "z"): "new", ("a", "old"): "exist", ("a", "n"): "new", ("z", "n"): "new", ("n", "far"): "new", ("old", "far"): "exist"}
    assert {r["id"]: r["origin"] for r in nodes.where("focus = 'far'").collect()}["lost"] == "context"

    about = {r["id"]: r for r in views.lineage_details(items, every).collect()}
    far = about["far"]
    assert (far["visual"], far["n_depends_on"], far["depends_on"], far["n_used_by"], far["used_by"]) == ("append", 3, ["lost", "n", "old"], 0, [])
    assert (about["a"]["n_used_by"], about["a"]["used_by"], about["lost"]["columns"], about["lost"]["n_used_by"]) == (4, ["gone", "n", "old", "z"], [], 0)
    assert about["gone"]["visual"] == "locked" and far["columns"] == ["id_key"] and far["n_columns"] == 1

    order = written(graph.topo_order(items, every), "order")
    place = {r["name"]: r["ord"] for r in order.collect()}
    keyed = sorted((r["status"] == "IGUAL", r["layer_order"], place.get(r["name"], 999), r["name"]) for r in items.collect())
    assert [tuple(r) for r in views.checklist(items, order).orderBy("pos").select("pos", "name", "suggested_order").collect()] == [(i, k[3], k[2]) for i, k in enumerate(keyed)]
    steps = report.roadmap_steps(items, order).orderBy("step").collect()
    assert [(r["step"], r["name"]) for r in steps] == [(1, "z"), (2, "n"), (3, "far")]
    assert report.roadmap(items, order).first()["markdown"].split("\n")[2:] == [r["line"] for r in steps]
    snippet = {r["name"]: r for r in report.snippets(items).collect()}
    assert snippet["far"]["snippet"].split("\n")[1:] == ["-- {{ ref('n') }}", "-- já na base: id_key", "-- ! SQL/corpo diferente no ZIP — NÃO reescreva o arquivo principal"]
    assert (snippet["n"]["present"], snippet["n"]["attention"], snippet["n"]["place"]) == ("", "", "id_key,a,z,JOIN")

    none = [views.macro_views(items.limit(0), every.limit(0), base.limit(0)), (views.lineage_details(items.limit(0), every.limit(0)), views.checklist(items.limit(0), order.limit(0)), report.roadmap_steps(items.limit(0), order.limit(0)))]
    assert [df.count() for group in none for df in group] == [0] * 6
