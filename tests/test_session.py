import json
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanloom.operators import integrity
from spanloom.plans import session as S
from spanloom.sources import project_files
from spanloom.sources.run_files import write_lines

DOMAINS = ["vendas", "frota", "financeiro", "rh"]
COLUMNS = ["id_key", "nm_nome", "cd_codigo", "ts_evento"]


def scale_project(root, workspace):
    """A layered project in four domains; the workspace adds a column to some models and brings new ones."""
    def put(path, sources, extra=False, columns=COLUMNS):
        path = root / path
        path.parent.mkdir(parents=True, exist_ok=True)
        body = ",\n  ".join(columns + (["qt_extra"] if extra and workspace else []))
        path.write_text(f"select\n  {body}\nfrom {sources[0]} a\n" + "".join(f"left join {s} b on a.id_key = b.id_key\n" for s in sources[1:]))

    ref = lambda n: f"{{{{ ref('{n}') }}}}"
    for d in DOMAINS:
        for i in range(1, 6):
            put(f"{d}/models/staging/stg_{d}_{i}.sql", [f"{{{{ source('raw', '{d}_src_{i}') }}}}"], i % 2 == 1)
        for i in range(1, 7):
            put(f"{d}/models/intermediate/int_{d}_{i}.sql", [ref(f"stg_{d}_{1 + (i + k) % 5}") for k in range(1 if i <= 2 else 2)], i <= 3)
        for i in range(1, 5):
            put(f"{d}/models/marts/fato_{d}_{i}.sql", [ref(f"int_{d}_{i + k}") for k in range(2 if i == 4 else 1)], i <= 2)
    tables = "".join(f"      - name: {d}_src_{i}\n" for d in DOMAINS for i in range(1, 6))
    (root / "schemas").mkdir()
    (root / "schemas/_sources.yml").write_text("sources:\n  - name: raw\n    tables:\n" + tables)
    for i in range(1, 9 if workspace else 7):
        swap = [c if c != "nm_nome" or not workspace or i > 4 else "qt_extra" for c in COLUMNS]
        put(f"vendas/models/aggregate/agg_resumo_{i}.sql", [ref(f"fato_{DOMAINS[i % 4]}_{1 + i % 4}")], columns=swap)
    if workspace:
        for i in range(1, 9):
            put(f"rh/models/intermediate/int_novo_card_{i}.sql", [ref(f"stg_rh_{1 + i % 5}")])
        for i in range(1, 5):
            put(f"rh/models/marts/fato_novo_card_{i}.sql", [ref(f"int_rh_{i}")])


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    top = tmp_path_factory.mktemp("scale")
    for name in ("base", "workspace"):
        (top / name).mkdir()
        scale_project(top / name, name == "workspace")
    text = {"base_project_path": "base", "workspace_path": "workspace", "output_path": "out", "snapshots_path": "snaps", "card_id": "c1", "enforce_taxonomy": False}
    (top / "config.json").write_text(json.dumps(text), encoding="utf-8-sig")
    return S.load_config(str(top / "config.json"))


def test_scale_project(spark, config):
    session = S.run(spark, config)
    s = session["summary"].first()
    assert (s["novo"], s["n_append"], s["igual"], s["renomeado"], s["removido"], s["alterado"]) == (14, 36, 31, 0, 0, 36)
    assert session["lineage_nodes"].count() == 101 and session["lineage_edges"].count() == 120
    assert session["order"].count() == 50 and session["cycles"].count() == 0
    by = {r["code"]: r["count"] for r in session["warnings"].groupBy("code").count().collect()}
    assert by["POLICY_APPEND"] == 36 and by["DEAD_MODEL"] == 8 and "BROKEN_REF" not in by
    S.save(config, session)
    manifest = S.close_card(spark, config, session)
    assert manifest["totals"]["planned"] == 50 and not manifest["totals"]["complete"]
    assert S.timeline(spark, config.snapshots_path).first()["card_id"] == "c1"

    out, snaps = Path(config.output_path), Path(config.snapshots_path)
    said = json.loads((out / "session.json").read_text())
    assert (said["summary"]["novo"], said["summary"]["acrescentar"], said["summary"]["base_models"]) == (14, 36, 67)
    assert "36 arquivo(s)" in said["message"] and set(said["tables"]) == {p.name for p in (out / "session").iterdir()}
    rows = lambda folder: [json.loads(x) for p in sorted(folder.iterdir()) for x in p.read_text().splitlines()]
    reach = {r["id"]: r for r in rows(out / "session/lineage_reach")}
    assert len(reach) == 101 and reach["fato_vendas_1"]["upstream"] == ["source.raw.vendas_src_2", "stg_vendas_2", "int_vendas_1"]
    assert reach["agg_resumo_1"]["n_downstream"] == 0 and reach["agg_resumo_1"]["n_base_columns"] == 4
    assert [r["edge_ord"] for r in sorted(rows(out / "session/lineage_edges"), key=lambda r: r["edge_ord"])] == list(range(120))
    assert (out / "roteiro.md").read_text().count("- [ ]") == 50
    plan = {r["model"]: r for r in rows(snaps / "c1/plan")}
    assert len(plan) == 50 == manifest["pending_count"] and plan["int_novo_card_1"]["action"] == "create"
    assert [i["name"] for i in plan["stg_rh_1"]["add_items"]] == ["qt_extra"] and plan["stg_rh_1"]["label"]
    assert len(rows(snaps / "c1/changes")) == len(rows(snaps / "c1/structural_hashes")) == 50
    assert S.history(spark, config.snapshots_path, "changes", "model string, status string").where("card_id = 'c1' and status = 'NOVO'").count() == 14
    assert not list(out.rglob("*.part")) and not list(snaps.rglob("*.part"))


def test_configuration(spark, config, tmp_path):
    assert S.problems(config) == []
    bad = lambda **changes: len(S.problems(replace(config, **changes)))
    base = config.base_project_path
    assert bad(output_path="") == bad(snapshots_path=f"{base}/x") == bad(aliases={"a": ""}) == bad(aliases=["a"]) == bad(match_threshold="much") == bad(match_threshold=1.5) == 1
    assert bad(base_include=["vendas"]) == 0 and bad(base_include=["nowhere"]) == bad(base_include=["../x"]) == bad(base_include="vendas") == bad(base_include=[" "]) == 1
    card = lambda c: S.safe_card(spark, replace(config, card_id=c))
    assert [card(c) for c in ("a/b c", "../..", "", "é-1", "x" * 90)] == ["a_b_c", S.NO_CARD, S.NO_CARD, "é-1", "x" * 80]
    (tmp_path / "c.json").write_text("[]")
    with pytest.raises(ValueError):
        S.load_config(str(tmp_path / "c.json"))


def test_base_integrity(spark, config, tmp_path):
    for path in ("a/x.sql", "a/b/y.sql", "c/z.sql"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("select 1")
    own = replace(config, base_project_path=str(tmp_path))
    before = S.base_tree(spark, own)
    S.check_base(spark, own, before)
    (tmp_path / "a/b/y.sql").write_text("select 2")
    found = {r["folder"]: (r["n_before"], r["n_after"]) for r in integrity.changed(before, S.base_tree(spark, own)).collect()}
    assert found == {"": (3, 3), "a": (2, 2), "a/b": (1, 1)}
    with pytest.raises(RuntimeError, match="a/b"):
        S.check_base(spark, own, before)
    (tmp_path / "a/b/y.sql").write_text("select 1")
    (tmp_path / "c/z.sql").rename(tmp_path / "c/w.sql")
    assert {r["folder"] for r in integrity.changed(before, S.base_tree(spark, own)).collect()} == {"", "c"}
    none = spark.createDataFrame([], "path string, text string")
    assert integrity.tree(none).count() == 0 and integrity.changed(integrity.tree(none), before).count() == 4


def test_lines_in_order_and_aborted_writes(spark, tmp_path):
    out = str(tmp_path / "out")
    lines = spark.range(1000).repartition(7).orderBy("id").select(F.col("id").cast("string").alias("line"))
    write_lines(lines, f"{out}/all.txt", out, single=True)
    assert (tmp_path / "out/all.txt").read_text().splitlines() == [str(i) for i in range(1000)]
    write_lines(lines, f"{out}/parts", out)
    write_lines(lines.limit(0), f"{out}/none", out)
    assert list((tmp_path / "out/none").iterdir()) == []
    broken = lines.select(F.when(F.col("line") == "900", F.raise_error(F.lit("no"))).otherwise(F.col("line")).alias("line"))
    for single, name in ((True, "all.txt"), (False, "parts")):
        with pytest.raises(Exception, match="no"):
            write_lines(broken, f"{out}/{name}", out, single=single)
    # What was there before is whole, and nothing else is left.
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["all.txt", "none", "parts"]
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "out/parts").iterdir()) == 1000
    write_lines(lines.limit(3), f"{out}/parts", out)
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "out/parts").iterdir()) == 3
    for path in ("/elsewhere/f", out, f"{out}/../f"):
        with pytest.raises(PermissionError):
            write_lines(lines, path, out)


def test_scan_leaves_out_and_counts(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"d{k % 20}/e{k}").mkdir(parents=True)
        (tmp_path / f"d{k % 20}/e{k}/m.sql").write_text("x" * k)
    (tmp_path / "d1/link.sql").symlink_to(tmp_path / "d0/e0/m.sql")
    (tmp_path / "d2/e2/node_modules").mkdir()
    (tmp_path / "d2/e2/node_modules/n.sql").write_text("x")
    read = lambda **o: [(r["path"], len(r["text"]), r["scan_ord"]) for r in project_files.read_project(spark, str(tmp_path), "base", **o).orderBy("scan_ord").collect()]
    want = sorted((f"d{k % 20}/e{k}/m.sql", k) for k in range(40))
    assert read() == [(*w, i) for i, w in enumerate(want)]
    assert read(include=["d3", "d3", "gone"]) == [("d3/e23/m.sql", 23, 0), ("d3/e3/m.sql", 3, 1)]
    assert [r[:2] for r in read(most_bytes=30)] == [w for w in want if w[1] <= 30] and len(read(most_files=5)) == 5
    lost = {r["left_out"]: (r["n"], r["bytes"]) for r in project_files.left_out(spark, str(tmp_path), "base", most_bytes=30).collect()}
    assert lost == {"size": (9, sum(range(31, 40))), "link": (1, 0)}
    (tmp_path / "empty").mkdir()
    assert project_files.read_project(spark, str(tmp_path / "empty"), "base").count() == 0


def test_files(spark, tmp_path):
    for path in ("a/_x.sql", "a/.hidden.sql", "target/y.sql", "b/z.YML", "b/q.txt"):
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(b"caf\xff\r\nx")
    rows = project_files.read_project(spark, str(tmp_path), "base").collect()
    assert [(r["path"], r["text"]) for r in rows] == [("a/_x.sql", "caf�\nx"), ("b/z.YML", "caf�\nx")]
    assert project_files.read_project(spark, str(tmp_path), "base", ["b"]).count() == 1
    assert project_files.top_folders(str(tmp_path)) == ["a", "b"] and project_files.inside("/x", str(tmp_path)) is None
    with pytest.raises(PermissionError):
        S._write("/elsewhere/f", "", [str(tmp_path)])
