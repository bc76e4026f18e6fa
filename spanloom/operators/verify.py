"""Closing a card: is what was planned now in the base?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(items: DataFrame, base_now: DataFrame) -> DataFrame:
    """Planned items (create, append) with result and missing columns.

    create: ok if a model of that name exists, else missing. append: missing_file without the model (that of
    match_name, if any); else ok, partial or missing as all, some or none of the added columns are there. References are
    not looked at; nothing to add is ok.
    """
    plan = items.where("policy_action in ('create', 'append')").select("name", F.coalesce("match_name", "name").alias("target"), "policy_action", F.transform(F.filter("add_items", lambda i: i["kind"] == "coluna"), lambda i: F.lower(i["name"])).alias("wanted"))
    now = base_now.select(F.col("name").alias("target"), F.col("columns").alias("now"))
    rows = plan.withColumn("target", F.when(F.col("policy_action") == "create", F.col("name")).otherwise(F.col("target"))).join(now, "target", "left")
    rows = rows.withColumn("missing", F.when(F.col("now").isNull(), F.col("wanted")).otherwise(F.array_sort(F.array_except("wanted", "now"))))
    append = F.when(F.col("now").isNull(), "missing_file").when(F.size("missing") == 0, "ok").when(F.size("missing") < F.size("wanted"), "partial").otherwise("missing")
    create = F.when(F.col("now").isNull(), "missing").otherwise("ok")
    return rows.withColumn("result", F.when(F.col("policy_action") == "create", create).otherwise(append)).select("name", "policy_action", "result", "missing")


def totals(checked: DataFrame) -> DataFrame:
    """(planned, done, complete): complete if nothing is missing or partial."""
    return checked.agg(F.count("*").alias("planned"), F.count_if(F.col("result") == "ok").alias("done"), F.coalesce(F.bool_and(F.col("result") == "ok"), F.lit(True)).alias("complete"))
