import pytest

from spanloom.functions.yaml_lite import read_lines
from spanloom.operators import catalog

FILES = "project string, path string, text string, scan_ord long"


def parsed(spark, *files):
    rows = [("base", path, text, i) for i, (path, text) in enumerate(files)]
    return {r["path"]: r for r in catalog.parse(spark.createDataFrame(rows, FILES)).collect()}


def test_fields_of_sql_text(spark):
    m1 = """select a.id, b.x as y, cast(c as numeric(10,2)) as vr_c, count(*) from {{ ref('A') }} a left outer join {{ ref("B") }} b"""
    got = parsed(
        spark,
        ("models/staging/m1.sql", m1),
        ("models/m2.sql", "with q as (select k from {{ ref('r') }}) select z from q"),
        ("models/m3.sql", "-- {{ ref('no') }}\n/* {{ ref('no2') }} */ {{ ref('pkg','m') }} {{ source('s', 't') }}"),
        ("seeds/x.csv", "a,b\r\n1,2"),
    )
    a = got["models/staging/m1.sql"]
    assert (a["refs"], a["columns"], a["joins"], a["casts"]) == (["A", "B"], ["id", "vr_c", "y"], ["JOIN"], ["CAST"])
    assert got["models/m2.sql"]["columns"] == ["k"]
    assert got["models/m3.sql"]["refs"] == [] and [tuple(s) for s in got["models/m3.sql"]["sources"]] == [("s", "t")]
    assert got["seeds/x.csv"]["type"] == "seed"


def test_equal_but_for_case_space_and_comments(spark):
    got = parsed(spark, ("a.sql", "SELECT x\nFROM {{ ref('A') }} -- c"), ("b.sql", "select  x from {{ ref('A') }} /* d */"), ("c.sql", "select x from {{ ref('a') }}"))
    a, b, c = (got[f"{k}.sql"] for k in "abc")
    assert (a["content_hash"], a["hash"]) == (b["content_hash"], b["hash"])
    assert a["content_hash"] == c["content_hash"] and a["hash"] != c["hash"]


def test_hash_is_that_of_sorted_json(spark):
    import hashlib
    import json

    a = parsed(spark, ("a.sql", """select x, "é" as y from {{ ref('A') }} join {{ source('s', 't') }}"""))["a.sql"]
    payload = {"refs": a["refs"], "sources": [list(s) for s in a["sources"]], "joins": a["joins"], "casts": a["casts"], "columns": a["columns"]}
    assert a["hash"] == hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


@pytest.mark.parametrize(
    ("path", "layer", "domain"),
    [("models/staging/x.sql", "staging", ""), ("models/marts/stg_x.sql", "staging", ""), ("macros/x.sql", "other", ""), ("fct_x.sql", "other", "fct_x.sql"), ("models/int_x.sql", "intermediate", ""), ("seeds/x.csv", "other", ""), ("rh/models/agg/y.sql", "aggregate", "rh")],
)
def test_layers_and_domains(spark, path, layer, domain):
    got = parsed(spark, (path, "select 1 as one from t"))[path]
    assert (got["layer"], got["domain"]) == (layer, domain)


def test_yaml_structures():
    text = "sources:\n  - name: raw\n    tables:\n      - name: t1\n        columns:\n          - name: id\n      - name: 't2'\n  - name: other\nmodels:\n  - name: m1\n    columns:\n      - name: c\n"
    assert read_lines(text) == ([("raw", "t1"), ("raw", "id"), ("raw", "t2")], ["m1"])
    assert read_lines("") == ([], [])


def test_collisions(spark):
    files = [("x/foo.yml", "models:\n"), ("y/foo.sql", "select a from t"), ("p/bar.sql", "select a from t"), ("q/bar.sql", "select b from t")]
    models = catalog.dedupe(catalog.parse(spark.createDataFrame([("base", p, t, i) for i, (p, t) in enumerate(files)], FILES)))
    got = {r["name"]: (r["path"], r["collisions"], r["name_collision"]) for r in models.collect()}
    assert got == {"foo": ("y/foo.sql", [], True), "bar": ("p/bar.sql", ["q/bar.sql"], True)}
