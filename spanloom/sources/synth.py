"""Synthetic projects over the part table: one SQL model per part, in a base and a workspace that differs in known ways."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, diff

#: Portable SQL: the same text in Spark and in other engines. {k} is the part's number.
NAME = "(case {k} % 5 when 0 then 'stg_m' when 1 then 'int_m' when 2 then 'fct_m' when 3 then 'dim_m' else 'agg_m' end || cast({k} as varchar(20)))"
FOLDER = "(case {k} % 5 when 0 then 'staging' when 1 then 'intermediate' when 4 then 'aggregate' else 'marts' end)"


def name(k: str) -> str:
    return NAME.format(k=k)


HALF, SEVEN = "cast(floor(k / 2.0) as bigint)", "cast(floor(k * 7 / 10.0) as bigint)"
HEAD = "'-- model ' || cast(k as varchar(20)) || chr(10) || 'select t.id_key, cast(t.vr_amt as numeric(10,2)) as vr_amt' || (case when k % 21 = 0 and project = 'workspace' then '' else ', nm_nome' end) || ', zz_x' || (case when k % 4 = 0 then ', safe_cast(t.qt_n as int64) as qt_n' else '' end) || (case when k % 11 = 0 then ', t.cd_code as cd_code' else '' end) || (case when k % 6 = 0 and project = 'workspace' then ', t.qt_extra as qt_extra' else '' end)"
FROM = f"""chr(10) || 'from ' || (case when k % 5 = 0 then '{{{{ source(''raw'', ''t' || cast(k % 50 as varchar(20)) || ''') }}}}' else '{{{{ ref(''' || {name(HALF)} || ''') }}}}' end) || ' t'"""
JOIN = f"""(case k % 3 when 1 then ' left join' when 2 then ' inner join' else '' end) || (case when k % 3 = 0 then '' else ' {{{{ ref("' || {name(SEVEN)} || '") }}}} u on t.id_key = u.id_key' end) || (case when k = 6 then ' cross join {{{{ ref(''agg_m24'') }}}} v' else '' end) || (case when k % 13 = 0 and project = 'workspace' then ' left join {{{{ ref(''ghost_m' || cast(k % 5 as varchar(20)) || ''') }}}} g' else '' end)"""
WHERE = "(case when k % 9 = 0 and project = 'workspace' then ' where t.id_key > ' || cast(k as varchar(20)) else '' end)"
#: (project, k, name, path, text, scan_ord): the base lacks every tenth, the workspace brings these and every third.
FILES = f"""
select project, k, name, path, scan_ord,
       (case when project = 'workspace' and k % 15 = 0 then replace(body, ' ', '  ') else body end) as text
from (
  select project, k, k as scan_ord, stem as name,
         'd' || cast(k % 7 as varchar(20)) || '/models/' || {FOLDER.format(k="k")} || '/' || stem || '.sql' as path,
         {HEAD} || {FROM} || {JOIN} || {WHERE} as body
  from (
    select project, k, {name("k")} || (case when project = 'workspace' and k % 33 = 0 then 's' else '' end) as stem
    from (select 'base' as project, p_partkey as k from part where p_partkey % 10 <> 0
          union all
          select 'workspace' as project, p_partkey as k from part where p_partkey % 3 = 0 or p_partkey % 10 = 0) a
  ) b
) c"""
#: Tables that the projects' YAML file declares; models use fifty.
DECLARED = 40
YAML = "sources:\n  - name: raw\n    tables:\n" + "".join(f"      - name: t{i}\n" for i in range(DECLARED)) + "models:\n  - name: stg_m5\n"


def files(spark: SparkSession, sf_dir: str, project: str) -> DataFrame:
    view = f"part_{uuid.uuid4().hex}"  # the caller may have a view named part
    # The table is small beside the work of parsing: its rows are dealt out, not left in the few tasks that its bytes would make.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").repartition(parts, "p_partkey").createOrReplaceTempView(view)
    found = spark.sql(FILES.replace("from part ", f"from {view} "))
    spark.catalog.dropTempView(view)
    return found.where(F.col("project") == project).select("project", "path", "text", F.col("scan_ord").cast("long").alias("scan_ord"))


def models(spark: SparkSession, sf_dir: str, project: str) -> DataFrame:
    return catalog.parse_sql_files(files(spark, sf_dir, project))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir, "base")


def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir, "workspace")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merged(base(spark, sf_dir), workspace(spark, sf_dir))


def yaml_models(spark: SparkSession) -> DataFrame:
    return catalog.parse(spark.createDataFrame([("base", "d0/models/_sources.yml", YAML, 0)], "project string, path string, text string, scan_ord long"))


#: Parts that one YAML file of the projects stands for.
PER_YAML = 100


def yaml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML file for each hundred parts: every fifth is declared as a table of source raw, every twentieth as a model."""
    k = F.col("p_partkey").cast("long")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), F.expr(f"cast(floor(p_partkey / {PER_YAML}) as bigint)").alias("g"))
    entries = lambda when, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("k", F.expr(line).alias("line"))))), lambda x: x["line"]), "")
    grouped = parts.groupBy("g").agg(entries(F.col("k") % 5 == 0, "'      - name: t' || k || '\\n'").alias("tables"), entries(F.col("k") % 20 == 1, f"'  - name: ' || {name('k')} || '\\n'").alias("models"))
    text = F.concat(F.lit("sources:\n  - name: raw\n    tables:\n"), "tables", F.lit("models:\n"), "models")
    return grouped.select(F.lit("base").alias("project"), F.expr("'d' || (g % 7) || '/models/_sources_' || g || '.yml'").alias("path"), text.alias("text"), F.col("g").alias("scan_ord"))


def items(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return diff.with_policy(diff.compare(base(spark, sf_dir), workspace(spark, sf_dir), **options))
