"""A whole run over two project folders: configuration, tables, and the files that it leaves."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import catalog, diff, graph, integrity, match, report, rules, verify, views
from ..shipping import ship_code
from ..sources.project_files import inside, read_project, top_folders
from ..sources.run_files import as_json, check_target, write_lines
from .tables import written


@dataclass(frozen=True)
class Config:
    base_project_path: str
    workspace_path: str
    output_path: str = "output"
    snapshots_path: str = "snapshots"
    card_id: str = "card"
    base_include: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    match_threshold: float = 0.62
    add_only: bool = True
    enforce_taxonomy: bool = True
    detect_removed: bool = False
    allow_empty_base: bool = False
    require_git_integrity: bool = False


#: Name of a card whose own name leaves nothing that is safe as a folder.
NO_CARD = "CARD-XXX"


def load_config(path: str) -> Config:
    """A JSON object, with or without a byte order mark; paths count from its folder, empty ones stay empty; unknown keys are left out, null is the default."""
    with open(path, encoding="utf-8-sig") as f:
        text = json.load(f)
    if not isinstance(text, dict):
        raise ValueError("the configuration is no JSON object")
    found = {k: v for k, v in text.items() if k in Config.__dataclass_fields__ and v is not None}
    here = os.path.dirname(os.path.abspath(path))
    paths = {k: os.path.normpath(os.path.join(here, v)) if v else "" for k, v in found.items() if k.endswith("_path")}
    return Config(**{"base_project_path": "", "workspace_path": ""} | found | paths)


def problems(config: Config) -> list[str]:
    """What keeps a configuration from being run."""
    out = [f"{k} is no folder" for k in ("base_project_path", "workspace_path") if not os.path.isdir(getattr(config, k))]
    written_to = ("output_path", "snapshots_path")
    out += [f"{k} is missing" for k in written_to if not getattr(config, k)]
    base = config.base_project_path
    if os.path.isdir(base):
        out += [f"{k} lies inside of the base" for k in ("workspace_path", *written_to) if getattr(config, k) and inside(getattr(config, k), base)]
    if not isinstance(config.aliases, dict) or not all(isinstance(x, str) and x for pair in config.aliases.items() for x in pair):
        out.append("aliases do not map names to names")
    threshold = config.match_threshold
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 <= threshold <= 1:
        out.append("match_threshold is not between 0 and 1")
    if not isinstance(config.base_include, list) or not all(isinstance(f, str) and f.strip() for f in config.base_include):
        return [*out, "base_include is no list of folder names"]
    for folder in config.base_include:
        if "/" in folder or "\\" in folder or ".." in folder:
            out.append(f"base_include: {folder} is a path, not a name")
        elif os.path.isdir(base) and not os.path.isdir(os.path.join(base, folder.strip())):
            out.append(f"base_include: the base has no folder {folder}")
    return out


def safe_card(spark: SparkSession, config: Config) -> str:
    """The card's name as it may name a folder."""
    return spark.range(1).select(P.card_id(F.lit(config.card_id), NO_CARD).alias("card")).first()["card"]


def base_tree(spark: SparkSession, config: Config) -> DataFrame:
    """Digests of the base's folders as they are now, over the files that a scan reads."""
    return written(integrity.tree(read_project(spark, config.base_project_path, "base", config.base_include)), "base-tree")


def check_base(spark: SparkSession, config: Config, before: DataFrame) -> None:
    """An error that names folders of the base (the first ten) which are not as they were."""
    found = integrity.changed(before, base_tree(spark, config)).orderBy("folder").limit(10).collect()
    if found:
        raise RuntimeError("the base changed: " + ", ".join(r["folder"] or "." for r in found))


def run(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """Tables of a session by name. With require_git_integrity also base_tree, which save() and close_card() hold against the base."""
    if found := problems(config):
        raise ValueError("; ".join(found))
    ship_code(spark)
    before = {"base_tree": base_tree(spark, config)} if config.require_git_integrity else {}
    load = lambda root, project, include: written(catalog.dedupe(catalog.parse(read_project(spark, root, project, include))), project)
    base = load(config.base_project_path, "base", config.base_include)
    # Folders of the base count for the workspace only if it has one of them.
    shared = [f for f in config.base_include if f in top_folders(config.workspace_path)]
    work = load(config.workspace_path, "workspace", shared)
    if base.isEmpty() and not config.allow_empty_base:
        raise ValueError("the base has no files")
    aliases = diff.alias_table(spark, config.aliases) if config.aliases else None
    taken = diff.matched(base, work, aliases).where("b_name is not null")
    orphans = work.join(taken.select(F.col("w_name").alias("name")), "name", "left_anti")
    free = base.join(taken.select(F.col("b_name").alias("name")), "name", "left_anti").join(work.select("name"), "name", "left_anti")
    renamed = match.renames(written(orphans, "orphans"), written(free, "free"), config.match_threshold)
    items = written(diff.with_policy(diff.compare(base, work, aliases=aliases, renames=renamed, detect_removed=config.detect_removed)), "items")
    models = written(catalog.merged(base, work), "models")
    items = written(diff.with_labels(items, config.add_only), "items")
    order = written(graph.topo_order(items, models), "order")
    warnings = written(rules.validate(items, models, base, add_only=config.add_only, enforce_taxonomy=config.enforce_taxonomy), "warnings")
    summary = written(diff.session_summary(items, warnings, base, work, config.add_only), "summary")
    lineage = written(views.lineage_details(items, models), "lineage")
    return before | {
        "items": items,
        "models": models,
        "warnings": warnings,
        "session_summary": summary,
        "message": diff.message(summary, add_only=config.add_only),
        "progress": diff.progress(items, config.add_only),
        "compare_order": diff.compare_order(items),
        "snippets": report.snippets(items),
        "order": order,
        "cycles": graph.find_cycles(models),
        "summary": diff.summary(items),
        "impact": graph.impact(models),
        "checklist": views.checklist(items, order),
        "lineage_nodes": lineage,
        "lineage_reach": views.lineage_reach(items, models),
        "lineage_edges": views.edge_order(items, models),
        "work_edges": views.work_edges(items, models),
        "item_impact": graph.item_impact(items, models),
        "cycle_report": graph.cycle_report(models),
        "chains": graph.flow_chains(items, models),
        "patterns": catalog.patterns(base),
        "roadmap": report.roadmap(items, order),
    }


#: Tables of a session that are texts or are not part of what it leaves.
NOT_SAVED = ("models", "roadmap", "base_tree")


def _write(path: str, text: str, roots: list[str]) -> None:
    """A short text, only below the folders that a run may write to."""
    if not any(inside(path, r) for r in roots):
        raise PermissionError(f"{path} is outside of {roots}")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def head(spark: SparkSession, config: Config, session: dict[str, DataFrame]) -> dict:
    """What a session says of itself: card, time, summary and message (one row each)."""
    return {"card_id": safe_card(spark, config), "timestamp": datetime.now().isoformat(timespec="seconds"), "summary": session["session_summary"].first().asDict(), "message": session["message"].first()["message"]}


def save(config: Config, session: dict[str, DataFrame]) -> None:
    """In the output folder session.json (head() and the names of the tables), a folder of JSON lines for each table, and roteiro.md. Tasks write the tables; none passes through the driver."""
    spark, out = session["items"].sparkSession, config.output_path
    names = [n for n in session if n not in NOT_SAVED]
    for name in names:
        write_lines(as_json(session[name]), os.path.join(out, "session", name), out)
    write_lines(session["roadmap"].select("markdown"), os.path.join(out, "roteiro.md"), out, single=True)
    if "base_tree" in session:
        check_base(spark, config, session["base_tree"])
    _write(os.path.join(out, "session.json"), json.dumps(head(spark, config, session) | {"tables": names}, ensure_ascii=False, indent=1), [out])


def planned(items: DataFrame) -> DataFrame:
    """What a card creates or extends, with all that is added."""
    return items.where("policy_action in ('create', 'append')").select(F.col("name").alias("model"), F.col("policy_action").alias("action"), "status", "path", F.coalesce("domain", F.lit("")).alias("domain"), "add_count", "add_items", "match_name", "label")


def close_card(spark: SparkSession, config: Config, session: dict[str, DataFrame]) -> dict:
    """Reads the base again and checks the plan against it; returns what manifest.json holds.

    The card's folder gets manifest.json (head(), counts and totals), pending.md, and as folders of JSON lines plan, changes (all that is
    not equal), structural_hashes of these, and verification.
    """
    if not session["warnings"].where("severity = 'critical' and code not like 'POLICY%'").isEmpty():
        raise ValueError("critical warnings are open")
    if "base_tree" in session:
        check_base(spark, config, session["base_tree"])
    now = catalog.dedupe(catalog.parse(read_project(spark, config.base_project_path, "base", config.base_include)))
    checked = written(verify.check(session["items"], now), "checked")
    manifest = head(spark, config, session)
    manifest |= {f"{k}_count": manifest["summary"][k] for k in ("critical", "warning", "pending", "renomeado")}
    manifest |= {"totals": verify.totals(checked).first().asDict()}
    snapshots = config.snapshots_path
    folder = os.path.join(snapshots, manifest["card_id"])
    check_target(folder, snapshots)
    changes = session["items"].where("status <> 'IGUAL'")
    tables = {
        "plan": planned(session["items"]),
        "changes": changes.select(F.col("name").alias("model"), "status", "policy_action", "path", "match_name", "add_count"),
        "structural_hashes": changes.select(F.col("name").alias("model"), F.coalesce("w_hash", "b_hash", F.lit("")).alias("hash")),
        "verification": checked,
    }
    for name, df in tables.items():
        write_lines(as_json(df), os.path.join(folder, name), snapshots)
    write_lines(report.pending(checked).select("markdown"), os.path.join(folder, "pending.md"), snapshots, single=True)
    _write(os.path.join(folder, "manifest.json"), json.dumps(manifest, ensure_ascii=False), [snapshots])
    return manifest


def timeline(spark: SparkSession, snapshots_path: str) -> DataFrame:
    """Manifests of closed cards by folder; what is no JSON is left out."""
    count = "critical_count long, warning_count long, pending_count long, renomeado_count long"
    schema = f"card_id string, timestamp string, message string, {count}, totals struct<planned: long, done: long, complete: boolean>"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{snapshots_path}/*/manifest.json")


def history(spark: SparkSession, snapshots_path: str, table: str, schema: str) -> DataFrame:
    """Rows of a table (plan, changes, structural_hashes, verification) of all closed cards, with the card's folder as card_id."""
    rows = spark.read.schema(schema).json(f"{snapshots_path}/*/{table}/*.jsonl")
    return rows.withColumn("card_id", F.element_at(F.split(F.input_file_name(), "/"), -3))
