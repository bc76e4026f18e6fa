"""The few YAML structures that matter (declared sources and models), read line by line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SECTION = re.compile(r"([A-Za-z_]\w*)\s*:\s*(?:#.*)?$")
_NAME = re.compile(r"(\s*)-\s*name:\s*([^\n#]+)")
_TABLES = re.compile(r"(\s+)tables:\s*")
_PAIR = T.StructType().add("schema", T.StringType()).add("table", T.StringType())
SCHEMA = T.StructType().add("sources", T.ArrayType(_PAIR)).add("columns", T.ArrayType(T.StringType()))


def read_lines(text: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(schema, table) of each table below a source, and names listed below models.

    Below `sources:` an entry opens a schema; once its deeper `tables:` came, every deeper entry is a table of it,
    column names included. Below `models:` entries indented by at most four count.
    """
    section, found, models = None, [], []
    schema, indent, tables = None, 0, False
    for line in (text or "").splitlines():
        if head := _SECTION.match(line):
            section = head[1].lower()
            continue
        entry = _NAME.match(line)
        name = entry[2].strip().strip("\"'") if entry else ""
        if section == "models" and entry and len(entry[1]) <= 4:
            models.append(name)
        if section != "sources":
            continue
        if entry and (schema is None or len(entry[1]) <= indent):
            schema, indent, tables = name, len(entry[1]), False
        elif schema is not None and (t := _TABLES.match(line)) and len(t[1]) > indent:
            tables = True
        elif schema is not None and tables and entry:
            found.append((schema, name))
    return found, models


@F.pandas_udf(SCHEMA)
def yaml_lite(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = [read_lines(t) for t in batch]
        yield pd.DataFrame({"sources": [[{"schema": s, "table": t} for s, t in r[0]] for r in rows], "columns": [r[1] for r in rows]})
