"""Texts for people: snippets, roadmap, what is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import numbered

#: Names of a kind that a snippet lists.
MOST_LISTED = 20


def listed(kind: str):
    return F.slice(F.transform(F.filter("add_items", lambda i: i["kind"] == kind), lambda i: i["name"]), 1, MOST_LISTED)


#: Notes on what is not applied that a snippet lists.
MOST_NOTES = 8


def snippets(items: DataFrame) -> DataFrame:
    """(name, policy_action, snippet, place, present, attention) of what is created or extended.

    The snippet has columns as lines to put into the select list, then references, sources and the rest as comments; of
    what is extended also the columns that the base has, and what the workspace changes otherwise. place, present and attention
    list all additions, columns of the base and ignored changes.
    """
    append = F.col("policy_action") == "append"
    none = F.array().cast("array<string>")
    present, notes = F.coalesce("b_columns", none), F.coalesce("ignored_changes", none)
    more = F.when(F.size(present) > MOST_LISTED, F.concat(F.lit(" … +"), (F.size(present) - MOST_LISTED).cast("string"))).otherwise("")
    lines = F.concat(
        F.array(F.concat(F.when(F.col("policy_action") == "create", "-- criar: ").otherwise("-- acrescentar em: "), "path")),
        F.transform(listed("coluna"), lambda c: F.concat(F.lit("  , "), c)),
        F.transform(listed("referência"), lambda r: F.concat(F.lit("-- {{ ref('"), r, F.lit("') }}"))),
        F.transform(listed("origem"), lambda r: F.concat(F.lit("-- {{ source('"), F.replace(r, F.lit("."), F.lit("', '")), F.lit("') }}"))),
        F.transform(F.concat(listed("join"), listed("cast")), lambda r: F.concat(F.lit("-- "), r)),
        F.when(append & (F.size(present) > 0), F.array(F.concat(F.lit("-- já na base: "), F.array_join(F.slice(present, 1, MOST_LISTED), ", "), more))).otherwise(none),
        F.when(append, F.transform(F.slice(notes, 1, MOST_NOTES), lambda n: F.concat(F.lit("-- ! "), n))).otherwise(none),
    )
    place = F.array_join(F.transform("add_items", lambda i: i["name"]), ",")
    return items.where("policy_action in ('create', 'append')").select("name", "policy_action", F.array_join(lines, "\n").alias("snippet"), place.alias("place"), F.array_join(present, ",").alias("present"), F.array_join(notes, "\n").alias("attention"))


def roadmap_steps(items: DataFrame, order: DataFrame) -> DataFrame:
    """(step, name, line): one row per step of the order that creates or extends a file, from 1 without gaps, numbered by ranges."""
    steps = order.join(items.where("policy_action in ('create', 'append')").select("name", "policy_action", "path", "add_count"), "name")
    line = F.format_string("- [ ] **%s** `%s` (%d)", F.when(F.col("policy_action") == "create", "Criar").otherwise("Acrescentar"), F.col("path"), F.col("add_count"))
    return numbered(steps.select("ord", "name", line.alias("line")), ["ord"], "step", "steps").select((F.col("step") + 1).alias("step"), "name", "line")


def roadmap(items: DataFrame, order: DataFrame) -> DataFrame:
    """(markdown): the lines of roadmap_steps() in one row, for people; it grows with the steps."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("step", "line"))), lambda x: x["line"])
    return roadmap_steps(items, order).agg(F.concat(F.lit("# Roteiro\n\n"), F.array_join(lines, "\n")).alias("markdown"))


def pending(checked: DataFrame) -> DataFrame:
    """(markdown): what verify.check() did not find, in one row."""
    left = checked.where("result <> 'ok'")
    line = F.concat(F.lit("- "), "name", F.lit(": "), "result", F.when(F.size("missing") > 0, F.concat(F.lit(" ("), F.array_join("missing", ", "), F.lit(")"))).otherwise(F.lit("")))
    return left.agg(F.concat(F.lit("# Pendências\n\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("markdown"))
