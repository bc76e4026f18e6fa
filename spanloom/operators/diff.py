"""Comparing a workspace with its base: statuses, differences, additions and the policy that follows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import vocabulary as V
from ..plans.tables import numbered

ITEM = "struct<kind: string, name: string, prefix: string, dbt_type: string>"
FIELDS = ["path", "type", "layer", "domain", "refs", "sources", "joins", "casts", "columns", "content_hash", "hash"]


def alias_table(spark: SparkSession, aliases: dict[str, str]) -> DataFrame:
    """(name, target, back): what each name stands for, forwards before backwards, the first entry before later ones."""
    rows = [(a, b, 0, i) for i, (a, b) in enumerate(aliases.items())] + [(b, a, 1, i) for i, (a, b) in enumerate(aliases.items())]
    table = spark.createDataFrame(rows, "name string, target string, back int, ord int")
    return table.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("back", "ord"))).where("n = 1").select("name", "target")


def side(models: DataFrame, prefix: str) -> DataFrame:
    return models.select(F.col("name").alias(f"{prefix}_name"), *[F.col(c).alias(f"{prefix}_{c}") for c in FIELDS])


def matched(base: DataFrame, workspace: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Workspace models with the base model of the same name, else of their alias; w_* and b_* columns and alias (boolean).

    An alias holds if its target is in the base and neither a workspace model of that name nor an earlier alias (by
    layer rank, then name) has it.
    """
    w, b = side(workspace, "w"), side(base, "b")
    exact = w.join(b, F.col("w_name") == F.col("b_name"), "left").withColumn("alias", F.lit(False))
    if aliases is None:
        return exact
    # A target that an exact match claims first, in order of processing, is taken; one that comes later is not yet.
    order = F.struct(P.layer_rank(F.col("w_layer")).alias("rank"), F.col("w_name").alias("name"))
    claims = exact.where("b_name is not null").select(F.col("b_name").alias("target"), order.alias("claim"))
    free = exact.where("b_name is null").select("w_name", order.alias("ord")).join(aliases.withColumnRenamed("name", "w_name"), "w_name").join(base.select(F.col("name").alias("target")), "target")
    free = free.join(claims, "target", "left").where("claim is null or claim > ord")
    won = free.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("ord"))).where("n = 1").select("w_name", "target")
    rest = w.join(won, "w_name").join(b, F.col("target") == F.col("b_name")).drop("target").withColumn("alias", F.lit(True))
    return exact.join(won, "w_name", "left_anti").unionByName(rest)


def equal() -> Column:
    """Both hashes agree."""
    return F.col("w_content_hash").eqNullSafe(F.col("b_content_hash")) & F.col("w_hash").eqNullSafe(F.col("b_hash"))


def compare(base: DataFrame, workspace: DataFrame, *, aliases: DataFrame | None = None, renames: DataFrame | None = None, detect_removed: bool = False) -> DataFrame:
    """One row per workspace model, and with detect_removed per base model that none of them stands for: name, status, match_name, w_* and b_*.

    renames: (name, match_name, score) of workspace models that stand for a base model of another name.
    """
    rows = matched(base, workspace, aliases)
    rows = rows.withColumn("status", F.when(F.col("b_name").isNull(), "NOVO").when(equal(), "IGUAL").otherwise("ALTERADO"))
    rows = rows.withColumn("match_name", F.when(F.col("alias"), F.col("b_name"))).withColumn("match_score", F.when(F.col("alias"), 1.0)).withColumn("name", F.col("w_name"))
    if renames is not None:
        new = rows.where("status = 'NOVO'").drop("match_name", "match_score", *[f"b_{c}" for c in ["name", *FIELDS]]).join(renames.select("name", "match_name", F.col("score").alias("match_score")), "name")
        new = new.join(side(base, "b"), F.col("match_name") == F.col("b_name")).withColumn("status", F.lit("RENOMEADO"))
        rows = rows.join(new.select("name"), "name", "left_anti").unionByName(new)
    if detect_removed:
        taken = workspace.select("name").unionByName(rows.where("match_name is not null").select(F.col("match_name").alias("name")))
        gone = side(base.join(taken, "name", "left_anti"), "b").withColumn("status", F.lit("REMOVIDO")).withColumn("name", F.col("b_name"))
        rows = rows.unionByName(gone, allowMissingColumns=True)
    return rows


def added(field: str, w: str = "w", b: str = "b") -> Column:
    return F.array_sort(F.array_except(F.col(f"{w}_{field}"), F.col(f"{b}_{field}")))


def shown(field: str, value: Column, quoted: bool) -> Column:
    """A source is shown as a pair, or with a dot."""
    if field != "sources":
        return value
    return F.format_string("('%s', '%s')", value["schema"], value["table"]) if quoted else F.concat_ws(".", value["schema"], value["table"])


def semantic_diff() -> Column:
    """Lines '+ label item adicionada' and '- label item removida' by field; then a note if only the body, or also the body, differs."""
    def marked(field: str, items: Column, sign: str, label: str, done: str) -> Column:
        return F.transform(items, lambda x: F.concat(F.lit(f"{sign} {label} "), shown(field, x, True), F.lit(f" {done}")))

    lines = []
    for field, label in V.FIELD_LABELS:
        lines += [marked(field, added(field), "+", label, "adicionada"), marked(field, added(field, "b", "w"), "-", label, "removida")]
    body = F.when(F.col("w_content_hash") == F.col("b_content_hash"), None).when(F.col("w_hash") == F.col("b_hash"), F.lit("~ lógica/SQL alterada (mesmo refs/colunas, corpo diferente)")).otherwise(F.lit("~ conteúdo do arquivo alterado"))
    return F.array_compact(F.concat(F.flatten(F.array(*lines)), F.array(body)))


def add_items(new: Column) -> Column:
    """What the workspace brings: everything where new, else what the base lacks; columns with prefix and announced type."""
    def listed(field: str, label: str) -> Column:
        prefix = P.prefix_of if field == "columns" else lambda x: F.lit(None).cast("string")
        kind = (lambda x: P.type_of(P.prefix_of(x))) if field == "columns" else prefix
        make = lambda x: F.struct(F.lit(label).alias("kind"), shown(field, x, False).alias("name"), prefix(x).alias("prefix"), kind(x).alias("dbt_type"))
        return F.transform(F.when(new, F.col(f"w_{field}")).otherwise(added(field)), make)

    order = [V.FIELD_LABELS[2], V.FIELD_LABELS[0], V.FIELD_LABELS[1], *V.FIELD_LABELS[3:]]
    return F.coalesce(F.flatten(F.array(*[listed(*pair) for pair in order])), F.array().cast(f"array<{ITEM}>"))


def ignored_changes() -> Column:
    """What the workspace takes away or rewrites, which is not applied."""
    def dropped(field: str, label: str) -> Column:
        return F.transform(added(field, "b", "w"), lambda x: F.concat(F.lit(f"{label} removida no ZIP (ignore): "), x))

    gone = [dropped("columns", "coluna"), dropped("refs", "referência")]
    body = F.when(F.col("w_content_hash") != F.col("b_content_hash"), F.lit("SQL/corpo diferente no ZIP — NÃO reescreva o arquivo principal"))
    return F.coalesce(F.array_compact(F.concat(*gone, F.array(body))), F.array().cast("array<string>"))


def with_policy(rows: DataFrame) -> DataFrame:
    """compare() with diff, add_items, add_count, ignored_changes, policy_action, bucket, exists_in_base, layer, domain and table_kind.

    Additions of an alias are counted against no base model (its own name has none): all of its items count.
    """
    none = F.array().cast(f"array<{ITEM}>")
    changed = F.col("status").isin("ALTERADO", "RENOMEADO")
    rows = rows.withColumn("add_items", F.when(changed | (F.col("status") == "NOVO"), add_items((F.col("status") == "NOVO") | F.col("alias"))).otherwise(none))
    rows = rows.withColumn("add_count", F.size("add_items")).withColumn("diff", F.when(changed, semantic_diff()).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("ignored_changes", F.when(F.col("alias"), F.array().cast("array<string>")).otherwise(ignored_changes()))
    action = F.when(F.col("status") == "NOVO", "create").when(F.col("status") == "IGUAL", "exists").when(changed & (F.col("add_count") > 0), "append").when(F.col("status") == "ALTERADO", "skip").otherwise("review")
    bucket = F.create_map(*[F.lit(x) for pair in V.BUCKET.items() for x in pair])
    rows = rows.withColumn("policy_action", action).withColumn("bucket", F.element_at(bucket, F.col("policy_action"))).withColumn("exists_in_base", F.col("status") != "NOVO")
    rows = rows.withColumn("layer", F.coalesce("w_layer", "b_layer")).withColumn("layer_order", P.layer_rank(F.col("layer"))).withColumn("type", F.coalesce("w_type", "b_type"))
    rows = rows.withColumn("path", F.coalesce("b_path", "w_path")).withColumn("domain", F.coalesce(F.nullif("w_domain", F.lit("")), F.nullif("b_domain", F.lit("")), P.domain(F.col("path"))))
    for c in ("refs", "sources", "columns", "casts"):
        rows = rows.withColumn(c, F.coalesce(f"w_{c}", f"b_{c}"))
    return rows.withColumn("table_kind", P.table_kind(F.col("name"), F.col("layer"))).withColumn("pending", F.col("policy_action").isin("create", "append") | F.col("status").isin("NOVO", "ALTERADO", "RENOMEADO"))


def summary(items: DataFrame) -> DataFrame:
    """Counts of statuses and actions in one row."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in V.STATUSES] + [F.count_if(F.col("policy_action") == a).alias(f"n_{a}") for a in V.BUCKET]
    return items.agg(F.count("*").alias("total"), *counts, F.coalesce(F.sum("add_count"), F.lit(0)).alias("items_to_add"))


def compare_order(items: DataFrame) -> DataFrame:
    """(item_ord, name, status) in the order in which a comparison comes to its items.

    First what the base has by that name or alias, then what is new or renamed, both by layer rank and name; last
    what was removed, by name. One number carries the three phases; it is given by ranges, not in one task.
    """
    phase = F.when(F.col("status") == "REMOVIDO", 2).when(F.col("status").isin("NOVO", "RENOMEADO"), 1).otherwise(0)
    rows = items.select("name", "status", phase.alias("phase"), F.when(phase < 2, F.col("layer_order")).otherwise(0).alias("rank"))
    return numbered(rows, ["phase", "rank", "name"], "item_ord", "compare-order").select("item_ord", "name", "status")


def with_labels(items: DataFrame, add_only: bool = True) -> DataFrame:
    """items with label and hint: of the policy action, or of the status where the policy is not additive."""
    key, labels, hints = ("policy_action", V.POLICY_LABEL, V.POLICY_HINT) if add_only else ("status", V.STATUS_LABEL, V.STATUS_HINT)
    of = lambda table: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(key)), F.lit(""))
    return items.withColumns({"label": of(labels), "hint": of(hints)})


def session_summary(items: DataFrame, warnings: DataFrame, base: DataFrame, workspace: DataFrame, add_only: bool = True) -> DataFrame:
    """One row: counts of items by status and action, of warnings by severity and policy, of models, and of cycles (those that the warnings hold)."""
    count = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    pending = "policy_action in ('create', 'append')" if add_only else "status in ('NOVO', 'ALTERADO', 'REMOVIDO', 'RENOMEADO')"
    of_items = items.agg(
        count("policy_action = 'create' or status = 'NOVO'", "novo"),
        count("policy_action = 'append'", "acrescentar"),
        count("status = 'ALTERADO'", "alterado"),
        count("status = 'REMOVIDO'", "removido"),
        count("status = 'RENOMEADO'", "renomeado"),
        count("status = 'IGUAL'", "igual"),
        count("policy_action = 'skip'", "nao_alterar"),
        count("policy_action = 'review'", "revisar"),
        count(pending, "pending"),
    )
    of_warnings = warnings.agg(
        count("severity = 'critical' and not startswith(code, 'POLICY')", "critical"),
        count("severity = 'critical' and startswith(code, 'POLICY')", "policy_blocks"),
        count("startswith(code, 'POLICY') and label = 'Acrescentar'", "policy_append"),
        count("severity = 'warning'", "warning"),
        count("code = 'DAG_CYCLE'", "cycle_count"),
    )
    # Each side is one row.
    return of_items.crossJoin(of_warnings).crossJoin(base.agg(F.count("*").alias("base_models"))).crossJoin(workspace.agg(F.count("*").alias("workspace_models")))


def message(summary: DataFrame, *, base_missing: bool = False, add_only: bool = True) -> DataFrame:
    """(message) that a session shows first, from its summary."""
    def text(key: str) -> Column:
        parts = re.split(r"\{(\w+)\}", V.MESSAGES[key])
        return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    blocked = F.lit(add_only) & (F.col("policy_blocks") > 0)
    shown = (
        F.when(F.lit(base_missing), text("base"))
        .when(F.col("workspace_models") == 0, text("empty"))
        .when((F.col("pending") == 0) & (F.col("critical") == 0), text("done"))
        .when(F.col("critical") > 0, text("critical"))
        .when(F.lit(add_only) & (F.col("acrescentar") > 0), text("append"))
        .when(blocked & (F.col("novo") > 0), text("create"))
        .when(blocked, text("nothing"))
        .otherwise("")
    )
    return summary.select(shown.alias("message"))


def progress(items: DataFrame, add_only: bool = True) -> DataFrame:
    """(work, done, percent): 100 without work, else the truncated share of what is equal."""
    work = F.count_if(F.col("policy_action").isin("create", "append") if add_only else F.col("status") != "IGUAL")
    done = F.count_if(F.col("status") == "IGUAL")
    return items.agg(work.alias("work"), done.alias("done")).withColumn("percent", F.when(F.col("work") == 0, 100).otherwise(F.floor(100 * F.col("done") / F.greatest(F.col("work") + F.col("done"), F.lit(1)))).cast("int"))
