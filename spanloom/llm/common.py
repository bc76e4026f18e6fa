"""What the operators of this package share: the shared folder, written intermediates."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parts import components
from ..plans.tables import shared_dir, written

__all__ = ["components", "fold_ascii", "free_name", "new_path", "with_locator", "written"]

#: Letters that contracts fold; every other character stays as it is.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased, null as empty. Pure ASCII takes lower(), which is the same there and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores put before it until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_locator(df: DataFrame) -> tuple[DataFrame, str, str]:
    """df with the file and the row number that each row was read from, and those columns' names. A df that does not come from files is written first."""
    file, row = free_name(df, "loc_file"), free_name(df, "loc_row")
    try:
        out = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
        out.schema
    except AnalysisException:  # no file behind it, or more than one
        out = written(df, "rows").select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return out, file, row
