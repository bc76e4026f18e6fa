"""The registered queries over the synthetic projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import catalog, diff, graph, match, report, rules, verify, views
from ..sources import synth
from .tables import written

ALIASES = {"stg_m10": "int_m1", "fct_m12": "fct_m2", "int_m26": "stg_m20", "stg_m40": "int_m1"}


def joined(field: str, quoted: bool = False):
    return F.array_join(F.transform(field, lambda s: F.concat_ws(".", s["schema"], s["table"])) if field == "sources" else F.col(field), ",").alias(field)


def fixed(models: DataFrame) -> DataFrame:
    """Models that several steps read again."""
    return written(models, "models")


def extract(field: str):
    return lambda s, d: synth.base(s, d).select("name", joined(field))


def status_diff(s: SparkSession, d: str) -> DataFrame:
    return diff.compare(synth.base(s, d), synth.workspace(s, d), detect_removed=True).select("name", "status")


def status_summary(s: SparkSession, d: str) -> DataFrame:
    return diff.summary(synth.items(s, d, detect_removed=True))


def layer_detect(s: SparkSession, d: str) -> DataFrame:
    return synth.merged(s, d).select("name", "layer", P.layer_rank(F.col("layer")).alias("layer_order"), "domain")


def column_taxonomy(s: SparkSession, d: str) -> DataFrame:
    cols = synth.base(s, d).select(F.explode("columns").alias("column")).withColumn("prefix", P.prefix_of(F.col("column")))
    return cols.groupBy("column", "prefix").agg(F.count("*").alias("n")).withColumn("dbt_type", P.type_of(F.col("prefix")))


def catalog_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Every seventh model has a second file in another folder that is scanned later."""
    m = synth.base(s, d)
    again = m.where("scan_ord % 7 = 0").withColumns({"path": F.concat(F.lit("zz/"), "path"), "scan_ord": F.col("scan_ord") + 1_000_000})
    return catalog.dedupe(m.unionByName(again)).select("name", "path", F.array_join("collisions", ",").alias("collisions"), "name_collision")


def alias_match(s: SparkSession, d: str) -> DataFrame:
    rows = diff.compare(synth.base(s, d), synth.workspace(s, d), aliases=diff.alias_table(s, ALIASES))
    return rows.where("alias").select("name", "match_name", "status")


def exploded(field: str):
    return lambda s, d: synth.items(s, d).select("name", F.posexplode(field).alias("pos", "line"))


def add_items(s: SparkSession, d: str) -> DataFrame:
    return synth.items(s, d).select("name", F.explode("add_items").alias("i")).select("name", "i.kind", F.col("i.name").alias("item"), F.coalesce("i.prefix", F.lit("")).alias("prefix"), F.coalesce("i.dbt_type", F.lit("")).alias("dbt_type"))


def policy_actions(s: SparkSession, d: str) -> DataFrame:
    return synth.items(s, d, detect_removed=True).select("name", "status", "policy_action", "bucket", "add_count", "exists_in_base")


def name_core(s: SparkSession, d: str) -> DataFrame:
    return synth.workspace(s, d).select("name", P.name_prefix(F.col("name")).alias("prefix"), P.name_core(F.col("name")).alias("core"))


def some(s: SparkSession, d: str) -> DataFrame:
    """Roots of downstream, upstream and ego_view: aggregates, a fifth of the models. The queries named _all start from all nodes."""
    return synth.merged(s, d).where("layer = 'aggregate'").select(F.col("name").alias("root"))


def declared_and_all(s: SparkSession, d: str) -> DataFrame:
    return synth.merged(s, d).unionByName(synth.yaml_models(s))


def rule(f):
    return lambda s, d: f(s, d).select("severity", "label", "code", "model", "detail")


def warnings_sorted(s: SparkSession, d: str) -> DataFrame:
    """The warnings that SQL expresses: without cycles and undeclared sources, which warnings_all has."""
    return rules.validate(fixed(synth.items(s, d)), fixed(synth.merged(s, d)), fixed(synth.base(s, d)), cycles=False)


def warnings_all(s: SparkSession, d: str) -> DataFrame:
    """The whole validation: cycles too, and sources against what the YAML file declares."""
    return rules.validate(fixed(synth.items(s, d)), fixed(declared_and_all(s, d)), fixed(synth.base(s, d)))


def session_summary(s: SparkSession, d: str, warned=warnings_sorted) -> DataFrame:
    return diff.session_summary(fixed(synth.items(s, d)), warned(s, d), synth.base(s, d), synth.workspace(s, d))


def lineage_details(s: SparkSession, d: str) -> DataFrame:
    rows = views.lineage_details(fixed(synth.items(s, d)), fixed(synth.merged(s, d)))
    return rows.select("id", "layer", "status", "visual", "policy_action", "n_columns", joined("columns"), "n_depends_on", joined("depends_on"), "n_used_by", joined("used_by"))


def lineage_reach(s: SparkSession, d: str) -> DataFrame:
    rows = views.lineage_reach(fixed(synth.items(s, d)), fixed(synth.merged(s, d)))
    return rows.select("id", "n_upstream", joined("upstream"), "n_downstream", joined("downstream"), "n_base_columns", joined("base_columns"))


def macro_nodes(s: SparkSession, d: str) -> DataFrame:
    """Nodes of the views around all pending items."""
    items, models = fixed(synth.items(s, d)), fixed(synth.merged(s, d))
    return views.macro_nodes(items, models, fixed(synth.base(s, d)), views.macro_members(items, models, views.macro_foci(items)))


def macro_edges(s: SparkSession, d: str) -> DataFrame:
    items, models = fixed(synth.items(s, d)), fixed(synth.merged(s, d))
    return views.macro_edges(items, models, views.macro_foci(items))


def macro_heads(s: SparkSession, d: str) -> DataFrame:
    items = fixed(synth.items(s, d))
    return views.macro_heads(items, fixed(synth.merged(s, d)), views.macro_foci(items)).select("focus", "mode", "n_recompile", joined("recompile"))


def ordered(f):
    """f over all items and their order."""
    def run(s: SparkSession, d: str) -> DataFrame:
        items = fixed(synth.items(s, d))
        return f(items, graph.topo_order(items, fixed(synth.merged(s, d))))

    return run


def aliased(s: SparkSession, d: str) -> DataFrame:
    return synth.items(s, d, aliases=diff.alias_table(s, ALIASES))


def verify_base(s: SparkSession, d: str) -> DataFrame:
    """The base after half of the work: what has an even number was created, columns were appended for every fourth."""
    b, w = synth.base(s, d), synth.workspace(s, d)
    number = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    return b.where(number % 4 != 0).unionByName(w.where(number % 4 == 0)).dropDuplicates(["name"])


def queries() -> dict:
    m, i = synth.merged, synth.items
    out = {f"extract_{f}": extract(f) for f in ("refs", "sources", "joins", "casts", "columns")}
    out |= {
        "status_diff": status_diff,
        "status_summary": status_summary,
        "content_hash": lambda s, d: synth.workspace(s, d).select("name", "content_hash", "hash"),
        "layer_detect": layer_detect,
        "domain_counts": lambda s, d: i(s, d).groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "IGUAL").alias("n_open")),
        "table_kind": lambda s, d: m(s, d).select("name", P.table_kind(F.col("name"), F.col("layer")).alias("table_kind")),
        "column_taxonomy": column_taxonomy,
        "catalog_dedupe": catalog_dedupe,
        "merged_catalog": lambda s, d: m(s, d).select("name", "project", "path"),
        "alias_match": alias_match,
        "semantic_diff_items": exploded("diff"),
        "add_items": add_items,
        "ignored_changes": exploded("ignored_changes"),
        "policy_actions": policy_actions,
        "jaccard_pairs": lambda s, d: match.jaccard_pairs(synth.workspace(s, d), synth.base(s, d)),
        "name_core": name_core,
        "edges": lambda s, d: graph.edges(m(s, d)),
        "dependents": lambda s, d: graph.dependents(m(s, d)).select("ref", F.array_join("dependents", ",").alias("dependents"), "n"),
        "downstream": lambda s, d: graph.downstream(fixed(m(s, d)), some(s, d)),
        "upstream": lambda s, d: graph.upstream(fixed(m(s, d)), some(s, d)),
        "downstream_all": lambda s, d: graph.downstream(fixed(m(s, d))),
        "upstream_all": lambda s, d: graph.upstream(fixed(m(s, d))),
        "impact_counts": lambda s, d: graph.impact(fixed(m(s, d))),
        "cycle_nodes": lambda s, d: graph.cycle_nodes(fixed(m(s, d))),
        "dag_level": lambda s, d: graph.levels(fixed(m(s, d))),
        "broken_refs": rule(lambda s, d: rules.broken_refs(i(s, d), m(s, d))),
        "undeclared_sources": rule(lambda s, d: rules.undeclared_sources(i(s, d), declared_and_all(s, d))),
        "layer_violations": lambda s, d: rules.layer_violations(i(s, d), m(s, d)),
        "dead_models": rule(lambda s, d: rules.dead_models(i(s, d), m(s, d))),
        "similar_existing": rule(lambda s, d: rules.similar_existing(i(s, d), m(s, d))),
        "sample_without_staging": rule(lambda s, d: rules.samples_without_staging(i(s, d).withColumn("name", F.when(F.col("policy_action") == "create", F.concat("name", F.lit("_sample"))).otherwise(F.col("name"))), m(s, d))),
        "aggr_origin": lambda s, d: rules.aggregates_without_origin(i(s, d), m(s, d)),
        "naming_prefix_topk": lambda s, d: catalog.patterns(synth.base(s, d)).where("layer <> 'casts'"),
        "cast_counts": lambda s, d: catalog.patterns(synth.base(s, d)).where("layer = 'casts'").select("prefix", "n"),
        "name_rules": lambda s, d: synth.workspace(s, d).select(F.when(F.length("name") % 2 == 0, F.upper("name")).otherwise(F.concat(F.lit("7-"), "name")).alias("name")).select("name", F.array_join(P.name_issues(F.col("name")), ",").alias("issues")),
        "column_rules": rule(lambda s, d: rules.column_rules(i(s, d))),
        "safe_casts": rule(lambda s, d: rules.safe_casts(i(s, d))),
        "policy_warnings": rule(lambda s, d: rules.policy_warnings(i(s, d))),
        "removed_in_use": rule(lambda s, d: rules.removed_in_use(i(s, d, detect_removed=True), m(s, d))),
        "warnings_sorted": warnings_sorted,
        "progress_pct": lambda s, d: diff.progress(i(s, d)),
        "verify_create": lambda s, d: verify.check(i(s, d), verify_base(s, d)).where("policy_action = 'create'").select("name", "result"),
        "verify_append": lambda s, d: verify.check(i(s, d), verify_base(s, d)).where("policy_action = 'append'").select("name", "result", F.array_join("missing", ",").alias("missing")),
        "lineage_nodes": lambda s, d: views.lineage_nodes(i(s, d), m(s, d)).select("id", "layer", "status"),
        "lineage_edges": lambda s, d: views.lineage_edges(i(s, d), m(s, d)),
        "ego_view": lambda s, d: views.ego(fixed(m(s, d)), some(s, d)),
        "ego_view_all": lambda s, d: views.ego_all(fixed(m(s, d))),
        "path_edges": lambda s, d: views.path_edges(fixed(m(s, d)), "int_m6"),
        "node_search": lambda s, d: views.search(views.lineage_nodes(i(s, d), m(s, d)), " M1 ").select("id"),
        "lineage_details": lineage_details,
        "lineage_reach": lineage_reach,
        "compare_order": lambda s, d: diff.compare_order(i(s, d, detect_removed=True)),
        "edge_order": lambda s, d: views.edge_order(fixed(i(s, d)), fixed(m(s, d))),
        "macro_nodes": macro_nodes,
        "macro_edges": macro_edges,
        "macro_heads": macro_heads,
        "work_edges": lambda s, d: views.work_edges(fixed(i(s, d)), fixed(m(s, d))),
        "item_impact": lambda s, d: graph.item_impact(fixed(aliased(s, d)), fixed(m(s, d))),
        "action_labels": lambda s, d: diff.with_labels(i(s, d, detect_removed=True)).select("name", "label", "hint"),
        "status_labels": lambda s, d: diff.with_labels(i(s, d, detect_removed=True), add_only=False).select("name", "label", "hint"),
        "session_summary": lambda s, d: session_summary(s, d).drop("cycle_count"),
        "session_message": lambda s, d: diff.message(session_summary(s, d)),
        "snippets": lambda s, d: report.snippets(i(s, d)),
        "yaml_sources": lambda s, d: catalog.parse(synth.yaml_files(s, d)).select("name", "type", joined("sources"), joined("columns")),
        "flow_chains": lambda s, d: graph.flow_chains(fixed(i(s, d)), fixed(m(s, d))),
        # Without SQL: similarity by matching blocks, order by a heap, walks (of cycles in warnings_all, too), and prose.
        "warnings_all": warnings_all,
        "rename_match": lambda s, d: match.renames(fixed(rules_orphans(s, d)), fixed(rules_free(s, d))),
        "topo_order": lambda s, d: graph.topo_order(fixed(i(s, d)), fixed(m(s, d))),
        "order_meta": lambda s, d: views.order_meta(fixed(i(s, d)), fixed(m(s, d))),
        "cycle_paths": lambda s, d: graph.find_cycles(fixed(m(s, d))),
        "lane_layout": lambda s, d: views.lanes(fixed(views.lineage_nodes(i(s, d), m(s, d))), fixed(views.lineage_edges(i(s, d), m(s, d)))),
        "cycle_report": lambda s, d: graph.cycle_report(fixed(m(s, d))),
        "session_summary_all": lambda s, d: session_summary(s, d, warnings_all),
        "focus_order": ordered(views.focus_order),
        "checklist": ordered(views.checklist),
        "roadmap_steps": ordered(report.roadmap_steps),
        "roadmap_markdown": ordered(report.roadmap),
    }
    return out


def rules_orphans(s: SparkSession, d: str) -> DataFrame:
    return synth.workspace(s, d).join(synth.base(s, d).select("name"), "name", "left_anti")


def rules_free(s: SparkSession, d: str) -> DataFrame:
    return synth.base(s, d).join(synth.workspace(s, d).select("name"), "name", "left_anti")


