"""What work may grow with: tests on plans, rows and numbers of tasks."""

from spanloom.operators import match, rules
from spanloom.plans import tables
from spanloom.sources import synth


def test_parsing_is_dealt_out(spark, tmp_path):
    """A table of one small file is one split; its parts are parsed by as many tasks as a shuffle has."""
    spark.range(300).selectExpr("id as p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert spark.read.parquet(str(tmp_path / "part.parquet")).rdd.getNumPartitions() == 1
    base = synth.base(spark, str(tmp_path))
    assert base.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert base.count() == 270


def test_numbering_works_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1_000).mapInArrow(each, "id long")
    got = tables.numbered(rows, ["id"], "at", "test").where("at <> id").count()
    assert got == 0 and seen.value == 1_000


def test_similar_models_meet_only_the_first_of_each_reference(spark):
    """4,000 new and 4,000 known models share one reference: no step makes their 16 million pairs."""
    rows = [(f"stg_{s}{k:05d}", status, 3 - k % 2, ["hub", f"r{k}"]) for s, status in (("a", "IGUAL"), ("n", "NOVO")) for k in range(4_000)]
    rows += [("stg_gone", "REMOVIDO", 0, ["hub"]), ("int_x", "NOVO", 2, ["hub"]), ("abc", "NOVO", 2, ["hub"])]
    items = spark.createDataFrame(rows, "name string, status string, layer_order int, refs array<string>")
    out = rules.similar_existing(items, items)
    got = {r["model"]: r["detail"] for r in out.collect()}
    # By layer order, then name; removed ones last.
    assert got == {f"stg_n{k:05d}": "stg_a00001" for k in range(4_000)}
    met = []

    def joins(plan):
        kind = plan.getClass().getSimpleName()
        if "Join" in kind:
            met.append(plan.metrics().apply("numOutputRows").value())
        inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
        for p in [*inner, *[plan.children().apply(at) for at in range(plan.children().size())]]:
            joins(p)

    joins(out._jdf.queryExecution().executedPlan())
    assert met and max(met) <= 20_000


def test_renames_that_are_sure_do_not_meet_more_distant_names(spark, monkeypatch):
    """40 renamed models of like names and columns, each with one that has its reference: no other pair is scored."""
    seen, own = [], match.scored

    def counted(pairs, threshold):
        out = own(pairs, threshold)
        seen.append(out.count())
        return out

    monkeypatch.setattr(match, "scored", counted)
    schema = "name string, layer string, refs array<string>, sources array<struct<schema: string, table: string>>, columns array<string>, content_hash string, hash string"
    models = lambda p, end: spark.createDataFrame([(f"int_m{100 + k}{end}", "intermediate", [f"r{k}"], [], ["a", "b"], f"{p}{k}", f"{p}h{k}") for k in range(40)], schema)
    got = {r["name"]: r["match_name"] for r in match.renames(models("w", "s"), models("b", "")).collect()}
    assert got == {f"int_m{100 + k}s": f"int_m{100 + k}" for k in range(40)}
    assert sum(seen) == 40


def test_renames_of_equal_models_are_taken_without_their_pairs(spark, monkeypatch):
    """Against all pairs, best first; 40 models that differ in their names only, with 40 like them, are not scored in pairs (1,600), also where few tries are made."""
    schema = "name string, layer string, refs array<string>, sources array<struct<schema: string, table: string>>, columns array<string>, content_hash string, hash string"
    alike = lambda end: [(f"stg_m{k}{end}", "staging", [], [("raw", "t")], ["a", "b"], "same", "same") for k in range(100, 140)]
    other = lambda p, n: [(f"{p}{k * 37 % 101}_x{k}", "staging", [f"r{k % 3}"], [("raw", "t")] if k % 2 else [], ["a", "b", "c"][: 1 + k % 3], f"t{k % 5}", f"h{k % 4}") for k in range(n)]
    work, base = alike("s") + other("int_", 12), alike("") + other("fct_q", 14)
    table = lambda rows: spark.createDataFrame(rows, schema)
    every = match.side(table(work), "w").crossJoin(match.side(table(base), "b"))
    score = {(r["name"], r["match_name"]): r["score"] for r in match.scored(every, match.THRESHOLD).collect()}
    left, right, want = set(), set(), {}
    for (a, b), x in sorted(score.items(), key=lambda p: (-p[1], p[0])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want[a] = (b, round(x, 3))
    seen, own = [], match.scored

    def counted(pairs, threshold):
        out = own(pairs, threshold)
        seen.append(out.count())
        return out

    monkeypatch.setattr(match, "scored", counted)
    for tries in (300, 2):
        monkeypatch.setattr(match, "MOST_TRIES", tries)
        seen.clear()
        assert {r["name"]: (r["match_name"], r["score"]) for r in match.renames(table(work), table(base)).collect()} == want
        assert sum(seen) < 500
    assert len(score) > 1600 and len(want) > 42
