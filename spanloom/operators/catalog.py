"""From files to models: parsing, one model per name, and the merged catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions.yaml_lite import yaml_lite

SOURCES = "array<struct<schema: string, table: string>>"


def parse(files: DataFrame) -> DataFrame:
    """One model per file of files (project, path, text, scan_ord): name, type, layer, domain, what its text refers to, and hashes.

    All native but for YAML, whose files alone go through an Arrow function.
    """
    rows = files.withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    rows = rows.select("project", "path", "scan_ord", "text", P.stem(F.col("path")).alias("name"), P.extension(F.col("path")).alias("ext"), P.layer(F.col("path")).alias("layer"), P.domain(F.col("path")).alias("domain"))
    none, no_sources = F.array().cast("array<string>"), F.array().cast(SOURCES)

    clean = F.col("clean")
    sql = rows.where("ext = '.sql'").withColumn("clean", P.strip_comments(F.col("text")))
    sql = sql.select("project", "path", "scan_ord", "name", "layer", "domain", F.lit("model").alias("type"), P.refs(clean).alias("refs"), P.sources(clean).alias("sources"), P.joins(clean).alias("joins"), P.casts(clean).alias("casts"), P.columns(clean).alias("columns"), P.hash16(P.normal_body(clean)).alias("content_hash"))
    yaml = rows.where("ext in ('.yml', '.yaml')").withColumn("y", yaml_lite("text"))
    yaml = yaml.select("project", "path", "scan_ord", "name", "layer", "domain", F.when(F.size("y.sources") > 0, "source").otherwise("yaml").alias("type"), none.alias("refs"), F.col("y.sources").cast(SOURCES).alias("sources"), none.alias("joins"), none.alias("casts"), F.col("y.columns").alias("columns"), P.hash16(P.normal_body(F.col("text"))).alias("content_hash"))
    seed = rows.where("ext = '.csv'").select("project", "path", "scan_ord", "name", "layer", "domain", F.lit("seed").alias("type"), none.alias("refs"), no_sources.alias("sources"), none.alias("joins"), none.alias("casts"), none.alias("columns"), P.hash16(F.col("text")).alias("content_hash"))
    return with_hash(sql.unionByName(yaml).unionByName(seed))


def parse_sql_files(files: DataFrame) -> DataFrame:
    """parse() for .sql files only: no Python in the plan."""
    rows = files.select("project", "path", "scan_ord", P.stem(F.col("path")).alias("name"), P.layer(F.col("path")).alias("layer"), P.domain(F.col("path")).alias("domain"), F.lit("model").alias("type"), P.strip_comments(F.col("text")).alias("clean"))
    clean = F.col("clean")
    return with_hash(rows.withColumns({"refs": P.refs(clean), "sources": P.sources(clean), "joins": P.joins(clean), "casts": P.casts(clean), "columns": P.columns(clean), "content_hash": P.hash16(P.normal_body(clean))}).drop("clean"))


def with_hash(models: DataFrame) -> DataFrame:
    return models.withColumn("hash", P.structural_hash(*[F.col(c) for c in ("casts", "columns", "joins", "refs", "sources")]))


def dedupe(models: DataFrame) -> DataFrame:
    """One row per (project, name): SQL models before others, then the first scanned. collisions lists the paths of later files of the kept one's class, name_collision tells whether there was any other file."""
    other = F.col("type") != "model"
    order = Window.partitionBy("project", "name").orderBy(other, "scan_ord")
    same = Window.partitionBy("project", "name", other.cast("int"))
    every = Window.partitionBy("project", "name")
    losers = F.collect_list(F.struct("scan_ord", "path")).over(same)
    rows = models.withColumn("n", F.row_number().over(order)).withColumn("others", F.count("*").over(every) - 1).withColumn("mates", losers)
    rows = rows.where("n = 1").withColumn("collisions", F.transform(F.array_sort(F.filter("mates", lambda m: m["scan_ord"] != F.col("scan_ord"))), lambda m: m["path"]))
    return rows.withColumn("name_collision", F.col("others") > 0).drop("n", "others", "mates")


def merged(base: DataFrame, workspace: DataFrame) -> DataFrame:
    """All models, those of the workspace in place of those of the same name in the base."""
    return workspace.unionByName(base.join(workspace.select("name"), "name", "left_anti"))


def declared_sources(models: DataFrame) -> DataFrame:
    """(source) declared in YAML files, as source.schema.table."""
    of_yaml = F.col("type").isin("source", "yaml") | F.lower("path").endswith(".yml") | F.lower("path").endswith(".yaml")
    return models.where(of_yaml).select(F.explode("sources").alias("s")).select(F.concat_ws(".", F.lit("source"), "s.schema", "s.table").alias("source")).distinct()


def patterns(models: DataFrame) -> DataFrame:
    """(layer, prefix, n, rank): the five commonest name prefixes of each layer and casts (as layer 'casts'), and the twenty commonest prefixes of all (layer 'all'). Ties go to what was scanned first."""
    prefixed = models.where(F.contains("name", F.lit("_"))).select("layer", F.concat(F.split_part("name", F.lit("_"), F.lit(1)), F.lit("_")).alias("prefix"), "scan_ord")
    cast = models.select(F.lit("casts").alias("layer"), F.explode("casts").alias("prefix"), "scan_ord")
    counted = prefixed.unionByName(prefixed.withColumn("layer", F.lit("all"))).unionByName(cast).groupBy("layer", "prefix").agg(F.count("*").alias("n"), F.min("scan_ord").alias("first"))
    rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("n"), "first", "prefix"))
    return counted.withColumn("rank", rank).where("rank <= case layer when 'all' then 20 else 5 end").drop("first")
