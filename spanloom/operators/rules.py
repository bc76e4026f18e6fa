"""Validation: one function for each rule, each giving rows (severity, label, code, model, detail, emit_ord)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import vocabulary as V
from ..plans.tables import numbered, written
from . import catalog, graph


def warning(rows: DataFrame, severity, label, code: str, model="name", detail: Column | None = None, emit: int = 0) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(col(severity).alias("severity"), col(label).alias("label"), F.lit(code).alias("code"), F.col(model).alias("model"), (F.lit("") if detail is None else detail).alias("detail"), F.lit(emit).alias("emit_ord"))


def broken_refs(items: DataFrame, models: DataFrame) -> DataFrame:
    """References to what is no model: critical where the item is new, else a warning; equal items are passed over."""
    refs = items.where("status <> 'IGUAL'").select("name", "status", F.explode("refs").alias("ref")).where("not startswith(ref, 'source.')")
    broken = refs.join(models.select(F.col("name").alias("ref")), "ref", "left_anti")
    new = F.col("status") == "NOVO"
    return warning(broken, F.when(new, "critical").otherwise("warning"), F.when(new, "Bloqueio").otherwise("Atenção"), "BROKEN_REF", detail=F.col("ref"), emit=3)


def undeclared_sources(items: DataFrame, models: DataFrame) -> DataFrame:
    """Sources of what is created or extended that no YAML file declares; silent if nothing is declared at all."""
    declared = catalog.declared_sources(models)
    used = items.where("status <> 'IGUAL' and (policy_action in ('create', 'append') or status = 'NOVO')").select("name", F.explode("sources").alias("s")).select("name", F.concat_ws(".", F.lit("source"), "s.schema", "s.table").alias("source"))
    gate = declared.agg(F.count("*").alias("n")).where("n > 0")
    rows = used.join(declared, "source", "left_anti").join(F.broadcast(gate), F.lit(True))  # the gate is at most one row
    return warning(rows, "warning", "Sources", "UNDECLARED_SOURCE", detail=F.col("source"), emit=4)


def layer_violations(items: DataFrame, models: DataFrame) -> DataFrame:
    """(model, ref, from_layer, to_layer, kind): references to a later layer ('inverted'), and what is created or extended in mart or aggregate and refers to source or sample directly ('skip')."""
    known = models.select(F.col("name").alias("ref"), F.col("layer").alias("known"))
    rows = items.select("name", "layer", "status", "policy_action", F.explode("refs").alias("ref")).where("not startswith(ref, 'source.')").join(known, "ref", "left").withColumn("to_layer", F.coalesce("known", P.layer(F.col("ref"))))
    inverted = (P.layer_rank(F.col("to_layer")) > P.layer_rank(F.col("layer"))) & (F.col("layer") != "other") & (F.col("to_layer") != "other")
    actionable = F.col("policy_action").isin("create", "append") | (F.col("status") == "NOVO")
    skip = F.col("layer").isin("mart", "aggregate") & F.col("to_layer").isin("source", "sample") & actionable
    return rows.withColumn("kind", F.when(inverted, "inverted").when(skip, "skip")).where("kind is not null").select(F.col("name").alias("model"), "ref", F.col("layer").alias("from_layer"), "to_layer", "kind")


def layer_warnings(items: DataFrame, models: DataFrame) -> DataFrame:
    rows = layer_violations(items, models)
    return warning(rows.where("kind = 'inverted'"), "warning", "Camada", "LAYER_INVERTED", "model", F.col("ref"), 1).unionByName(warning(rows.where("kind = 'skip'"), "warning", "Camada", "LAYER_SKIP", "model", F.col("ref"), 1))


def policy_warnings(items: DataFrame) -> DataFrame:
    """Appends warn; what must be left alone, reviewed or not removed is critical policy."""
    about = lambda s, l, c: F.struct(F.lit(s).alias("s"), F.lit(l).alias("l"), F.lit(c).alias("c"))  # noqa: E731, E741
    known = F.when((F.col("policy_action") == "append") & F.col("status").isin("ALTERADO", "RENOMEADO"), about("warning", "Acrescentar", "POLICY_APPEND"))
    known = known.when((F.col("status") == "ALTERADO") & (F.col("policy_action") == "skip"), about("critical", "Não alterar", "POLICY_SKIP"))
    known = known.when(F.col("status").isin("RENOMEADO", "REMOVIDO"), about("critical", "Revisar", "POLICY_REVIEW"))
    return items.withColumn("w", known).where("w is not null").select(F.col("w.s").alias("severity"), F.col("w.l").alias("label"), F.col("w.c").alias("code"), F.col("name").alias("model"), F.col("add_count").cast("string").alias("detail"), F.lit(2).alias("emit_ord"))


def naming(items: DataFrame, base: DataFrame) -> DataFrame:
    """New names whose prefix is not among the five commonest of their layer in the base; detail is the commonest."""
    top = catalog.patterns(base).where("layer not in ('all', 'casts')")
    best = top.where("rank = 1").select("layer", F.col("prefix").alias("top"))
    rows = items.where("status = 'NOVO' and contains(name, '_')").withColumn("prefix", F.concat(F.split_part("name", F.lit("_"), F.lit(1)), F.lit("_"))).join(best, "layer").join(top.select("layer", "prefix"), ["layer", "prefix"], "left_anti")
    return warning(rows, "warning", "Atenção", "NAMING", detail=F.col("top"), emit=5)


def name_rules(items: DataFrame) -> DataFrame:
    rows = items.where("status = 'NOVO'").select("name", F.explode(P.name_issues(F.col("name"))).alias("issue"))
    return warning(rows, "warning", "Taxonomia", "NAME", detail=F.col("issue"), emit=6)


def kind_rules(items: DataFrame, models: DataFrame) -> DataFrame:
    """What new facts, dimensions and aggregates are to document, and aggregates that refer to neither a fact nor a dimension."""
    new = items.where("status = 'NOVO' and table_kind is not null")
    label = F.element_at(F.create_map(*[F.lit(x) for x in ("DIB", "Dimensão (DIB)", "AGGR", "Agregada (AGGR)", "F", "Fato (F)")]), F.col("table_kind"))
    return warning(new, "info", label, "KIND", detail=F.col("table_kind"), emit=7).unionByName(warning(aggregates_without_origin(items, models), "warning", "Agregada (AGGR)", "AGGR_ORIGIN", emit=7))


def aggregates_without_origin(items: DataFrame, models: DataFrame) -> DataFrame:
    """(name) of new aggregates with references, none of them to a fact or dimension."""
    refs = items.where("status = 'NOVO' and table_kind = 'AGGR'").select("name", F.explode("refs").alias("ref")).join(models.select(F.col("name").alias("ref"), F.col("layer").alias("ref_layer")), "ref", "left")
    return refs.groupBy("name").agg(F.bool_or(F.coalesce(P.table_kind(F.col("ref"), F.col("ref_layer")).isin("F", "DIB"), F.lit(False))).alias("ok")).where("not ok").select("name")


def column_rules(items: DataFrame) -> DataFrame:
    """Columns of new models with a two-letter prefix that is not known, and every cd_ column."""
    cols = items.where("status = 'NOVO'").select("name", F.explode("columns").alias("column")).withColumn("prefix", P.prefix_of(F.col("column")))
    unknown = warning(cols.where("prefix = '' and lower(column) rlike '^[a-z]{2}_'"), "warning", "Taxonomia", "PREFIX", detail=F.col("column"), emit=8)
    return unknown.unionByName(warning(cols.where("prefix = 'cd'"), "warning", "Taxonomia", "CODE", detail=F.col("column"), emit=8))


def safe_casts(items: DataFrame) -> DataFrame:
    return warning(items.where("status = 'NOVO' and (array_contains(casts, 'SAFE_CAST') or array_contains(casts, 'TRY_CAST'))"), "safe", "Seguro", "SAFE_CAST", emit=9)


def dead_models(items: DataFrame, models: DataFrame) -> DataFrame:
    """New models outside of source, mart, aggregate and seed to which nothing refers."""
    rows = items.where("status = 'NOVO' and type = 'model' and layer not in ('source', 'mart', 'aggregate', 'seed')")
    return warning(rows.join(graph.edges(models).select(F.col("ref").alias("name")), "name", "left_anti"), "info", "Info", "DEAD_MODEL", emit=11)


def removed_in_use(items: DataFrame, models: DataFrame) -> DataFrame:
    """Removed models to which something refers (not under the additive policy)."""
    gone = items.where("status = 'REMOVIDO'")
    return warning(gone.join(graph.edges(models).select(F.col("ref").alias("name")), "name", "left_semi"), "critical", "Bloqueio", "REMOVED_IN_USE", emit=10)


def samples_without_staging(items: DataFrame, models: DataFrame) -> DataFrame:
    """New samples for which neither models nor items have the staging model of the name that fits."""
    guess = F.replace(F.replace(F.lower("name"), F.lit("_sample"), F.lit("")), F.lit("sample_"), F.lit("stg_"))
    rows = items.where("status = 'NOVO' and (contains(lower(name), '_sample') or layer = 'sample')").withColumn("guess", F.when(F.startswith(guess, F.lit("stg_")), guess).otherwise(F.concat(F.lit("stg_"), guess)))
    known = models.select(F.col("name").alias("guess")).unionByName(items.select(F.col("name").alias("guess")))
    return warning(rows.join(known, "guess", "left_anti"), "info", "Info", "SAMPLE", detail=F.col("guess"), emit=12)


def similar_existing(items: DataFrame, models: DataFrame) -> DataFrame:
    """New models (names over three characters) and the first equal, changed or removed item whose name starts with the same word and that shares a reference."""
    word = F.split_part("name", F.lit("_"), F.lit(1))
    new = items.where("status = 'NOVO' and length(name) > 3").select("name", word.alias("word"), F.explode("refs").alias("ref"))
    old = items.where("status in ('IGUAL', 'ALTERADO', 'REMOVIDO')").select(F.col("name").alias("other"), word.alias("word"), F.struct((F.col("status") == "REMOVIDO").alias("r"), "layer_order", "name").alias("place"))
    refs = models.select(F.col("name").alias("other"), F.explode("refs").alias("ref"))
    # The first two of each word and reference are enough: all others come later, and at most one of these is the new model itself.
    order = Window.partitionBy("word", "ref").orderBy("place")
    old = old.join(refs, "other").withColumn("k", F.row_number().over(order)).where("k <= 2").select("word", "ref", "place")
    hits = new.join(old, ["word", "ref"]).where("name <> place.name")
    first = hits.groupBy("name").agg(F.min("place").alias("place")).select("name", F.col("place.name").alias("other"))
    return warning(first, "info", "Info", "SIMILAR", detail=F.col("other"), emit=13)


def rename_warnings(items: DataFrame) -> DataFrame:
    return warning(items.where("status = 'RENOMEADO'"), "warning", "Atenção", "RENAMED", detail=F.col("match_name"), emit=14)


def collisions(models: DataFrame) -> DataFrame:
    return warning(models.where("name_collision"), "warning", "Atenção", "COLLISION", detail=F.array_join(F.slice("collisions", 1, 5), ", "), emit=15)


def cycle_warnings(models: DataFrame) -> DataFrame:
    return warning(graph.find_cycles(models).withColumn("name", F.element_at("nodes", 1)), "critical", "Ciclo na DAG", "DAG_CYCLE", detail=F.col("path"))


def validate(items: DataFrame, models: DataFrame, base: DataFrame, *, add_only: bool = True, enforce_taxonomy: bool = True, cycles: bool = True) -> DataFrame:
    """All warnings, by severity and model, in the order of the rules: ord, severity, label, code, model, detail."""
    parts = [layer_warnings(items, models), broken_refs(items, models), undeclared_sources(items, models), naming(items, base), safe_casts(items), dead_models(items, models), samples_without_staging(items, models), similar_existing(items, models)]
    parts += [policy_warnings(items)] if add_only else [removed_in_use(items, models), rename_warnings(items)]
    if cycles:
        parts.append(cycle_warnings(models))
    if enforce_taxonomy:
        parts += [name_rules(items), kind_rules(items, models), column_rules(items)]
    if "name_collision" in models.columns:
        parts.append(collisions(models))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in V.SEVERITY_RANK.items() for x in pair]), F.col("severity")), F.lit(9))
    rows = reduce(DataFrame.unionByName, parts)
    keys = ["rank", "model", "emit_ord", "code", "detail"]
    rows = numbered(written(rows.withColumn("rank", rank), "warnings"), keys, "at", "warnings")
    return rows.withColumn("ord", (F.col("at") + 1).cast("int")).drop("emit_ord", "rank", "at")
