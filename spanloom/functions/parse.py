"""What is read from a file's text and path, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def strip_comments(text: Column) -> Column:
    """Block comments, then line comments, each to one space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def refs(clean: Column) -> Column:
    """Names in one-argument ref() calls, distinct and sorted."""
    return _set(_all(clean, V.REF))


def sources(clean: Column) -> Column:
    """(schema, table) of source() calls, distinct and sorted."""
    pairs = F.arrays_zip(_all(clean, V.SOURCE, 1).alias("schema"), _all(clean, V.SOURCE, 2).alias("table"))
    return _set(F.transform(pairs, lambda p: F.struct(p["schema"].alias("schema"), p["table"].alias("table"))))


def joins(clean: Column) -> Column:
    return _set(F.transform(_all(clean, V.JOIN), lambda j: F.replace(F.upper(j), F.lit("  "), F.lit(" "))))


def casts(clean: Column) -> Column:
    return _set(F.transform(_all(clean, V.CAST), lambda c: F.upper(c)))


def split_items(chunk: Column) -> Column:
    """Items between commas outside of parentheses, trimmed, empty ones left out. A closing parenthesis without an opening one counts for nothing."""
    def depth(piece: Column, start: Column) -> Column:
        marks = F.split(F.regexp_replace(piece, "[^()]", ""), "")
        return F.aggregate(marks, start, lambda d, c: F.when(c == "(", d + 1).when(c == ")", F.greatest(d - 1, F.lit(0))).otherwise(d))

    def step(acc: Column, piece: Column) -> Column:
        now = F.concat_ws(",", acc["open"], piece)
        level = depth(piece, acc["depth"])
        return F.struct(
            level.alias("depth"),
            F.when(level > 0, now).alias("open"),
            F.when(level > 0, acc["items"]).otherwise(F.concat(acc["items"], F.array(now))).alias("items"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("items"))
    whole = F.aggregate(F.split(chunk, ","), start, step, lambda acc: F.concat(acc["items"], F.array_compact(F.array(acc["open"]))))
    return F.filter(F.transform(whole, lambda i: F.trim(F.regexp_replace(i, r"(?U)\s+", " "))), lambda i: i != "")


def columns(clean: Column) -> Column:
    """Output names of the first select list: the alias, else the last identifier; the first 40 distinct ones, sorted."""
    def name(item: Column) -> Column:
        alias = F.regexp_extract(item, V.ALIAS, 1)
        return F.lower(F.when(alias != "", alias).otherwise(F.regexp_extract(item, V.TRAILING, 1)))

    names = F.transform(split_items(F.regexp_extract(clean, V.SELECT_LIST, 1)), name)
    return F.array_sort(F.slice(F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.isin(V.NOT_COLUMNS))), 1, V.MOST_COLUMNS))


def hash16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def normal_body(text: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def structural_hash(casts: Column, columns: Column, joins: Column, refs: Column, sources: Column) -> Column:
    """Hash of the sorted-key JSON of the five fields, with a space after each comma and colon."""
    quoted = lambda s: F.regexp_extract(F.to_json(F.array(s)), r"(?s)^\[(.*)\]$", 1)
    listed = lambda a, f: F.concat(F.lit("["), F.array_join(F.transform(a, f), ", "), F.lit("]"))
    pair = lambda p: F.concat(F.lit("["), quoted(p["schema"]), F.lit(", "), quoted(p["table"]), F.lit("]"))
    fields = [("casts", listed(casts, lambda s: quoted(F.upper(s)))), ("columns", listed(columns, lambda s: quoted(F.lower(s)))), ("joins", listed(joins, lambda s: quoted(F.upper(s)))), ("refs", listed(refs, quoted)), ("sources", listed(sources, pair))]
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), value) for name, value in fields])
    return hash16(F.concat(F.lit("{"), body, F.lit("}")))


def stem(path: Column) -> Column:
    """The file's name without folders and without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def layer(path: Column) -> Column:
    """Layer by the first word of the list that is a folder, starts a path part, or starts the file's name."""
    low = F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    name = F.substring_index(low, "/", -1)
    out = F.when(F.lit(False), "")
    for word, kind in V.LAYER_WORDS:
        out = out.when(F.contains(F.concat(low, F.lit("/")), F.lit(f"/{word}/")) | F.contains(low, F.lit(f"/{word}_")), kind)
    for word, kind in V.LAYER_WORDS:
        out = out.when(name.startswith(f"{word}_") | name.startswith(f"{word}."), kind)
    return out.otherwise("other")


def layer_rank(layer: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.LAYER_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, layer), F.lit(9))


def domain(path: Column) -> Column:
    """The first part of the path, unless it is one of the usual project folders."""
    first = F.split_part(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"), F.lit(1))
    return F.when(F.lower(first).isin(V.NO_DOMAIN), "").otherwise(first)


def table_kind(name: Column, layer: Column) -> Column:
    """AGGR, DIB, F or null."""
    n, at = F.lower(name), F.lower(F.coalesce(layer, F.lit("")))
    return (
        F.when(n.startswith("aggr_") | n.contains("_aggr_") | n.startswith("agg_") | (at == "aggregate"), "AGGR")
        .when(n.startswith("dib_") | n.contains("_dib_"), "DIB")
        .when(n.rlike("(^|_)f_"), "F")
        .when((at == "mart") & (n.contains("dim") | n.startswith("d_")), "DIB")
    )


def prefix_of(column: Column) -> Column:
    """The two-letter prefix of a column if it is a known one, else an empty string."""
    found = F.regexp_extract(F.lower(F.trim(column)), "^([a-z]{2})(?:_|$)", 1)
    return F.when(found.isin(*V.TYPE_OF_PREFIX), found).otherwise("")


def type_of(prefix: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.TYPE_OF_PREFIX.items() for x in pair])
    return F.coalesce(F.try_element_at(table, prefix), F.lit(""))


def name_prefix(name: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(name)), "^(" + "|".join(V.NAME_PREFIXES) + ")", 1)


def name_core(name: Column) -> Column:
    """The name without its known prefix, - and spaces as _, and a light singular."""
    core = F.translate(F.regexp_replace(F.lower(F.trim(name)), "^(" + "|".join(V.NAME_PREFIXES) + ")", ""), "- ", "__")
    return F.when(core.endswith("ies"), F.regexp_replace(core, "ies$", "y")).when(core.endswith("s") & ~core.endswith("ss"), F.regexp_replace(core, "s$", "")).otherwise(core)


def name_issues(name: Column) -> Column:
    """Broken rules of model names: long, case, separator, characters."""
    n = F.coalesce(name, F.lit(""))
    rules = F.array(
        F.when(F.length(n) > V.LONGEST_NAME, "long"),
        F.when(n != F.lower(n), "case"),
        F.when(n.contains("-") | n.contains(" "), "separator"),
        F.when(~F.lower(n).rlike("^[a-z][a-z0-9_]*$"), "characters"),
    )
    return F.when(n == "", F.array(F.lit("empty"))).otherwise(F.array_compact(rules))


def card_id(text: Column, default: str = "card") -> Column:
    """A name that is safe as a folder: other than word characters, . and - to _, no . or _ at the ends, 80 characters, never '..'."""
    s = F.substring(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w.-]+", "_"), F.lit("._")), 1, 80)
    return F.when((s == "") | s.contains(".."), default).otherwise(s)
