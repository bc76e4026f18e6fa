"""Puts this package on executors that do not have it, as Spark's --py-files would."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_code(spark: SparkSession) -> None:
    """Adds a zip of the package's sources to the session's files, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_spanloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spanloom-code-"), "spanloom.zip")  # executors fetch it later, so it stays
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent))
    context.addPyFile(str(path))
    context._spanloom_shipped = True
