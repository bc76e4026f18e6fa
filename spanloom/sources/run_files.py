"""Text files that a run leaves, as a Spark data source for writing: tasks write, one commit moves what they wrote into place."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .project_files import inside


def check_target(path: str, allowed: str) -> None:
    """Only below the folder that a run may write to."""
    if inside(path, allowed) in (None, "."):
        raise PermissionError(f"{path} is outside of {allowed}")


@dataclass
class _Part(WriterCommitMessage):
    place: int
    file: str
    lines: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.allowed, self.single = options["path"], options["allowed"], options.get("single", "false") == "true"
        check_target(self.path, self.allowed)
        # Beside the target, so that moving is a rename; one for each run, so that runs do not meet.
        self.scratch = f"{os.path.abspath(self.path)}.{uuid.uuid4().hex}.part"

    def write(self, rows: Iterator) -> _Part:
        os.makedirs(self.scratch, exist_ok=True)
        task, lines = TaskContext.get(), 0
        # Each attempt has a file of its own: only those that succeed are named to commit().
        path = os.path.join(self.scratch, f"{task.partitionId()}-{task.taskAttemptId()}")
        with open(path, "w", encoding="utf-8", newline="\n") as f:
            for row in rows:
                f.write(row[0] + "\n")
                lines += 1
        return _Part(task.partitionId(), path, lines)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m and m.lines), key=lambda m: m.place)
        os.makedirs(self.scratch, exist_ok=True)
        ready = os.path.join(self.scratch, "ready")
        if self.single:
            with open(ready, "wb") as out:
                for m in parts:
                    with open(m.file, "rb") as f:
                        shutil.copyfileobj(f, out)
            os.replace(ready, self.path)
        else:
            os.mkdir(ready)
            for k, m in enumerate(parts):
                os.rename(m.file, os.path.join(ready, f"part-{k:05d}.jsonl"))
            if os.path.isdir(self.path):
                os.rename(self.path, os.path.join(self.scratch, "before"))
            os.rename(ready, self.path)
        shutil.rmtree(self.scratch)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.scratch, ignore_errors=True)


class RunFiles(DataSource):
    """format("runfiles"), options path, allowed (the folder that path must lie in), single: rows of one string column become lines.

    path becomes a folder of numbered parts, or with single one file, put together from the parts in their order. Either
    replaces what was there, by renames, once all tasks have succeeded; an aborted run leaves what was there.
    """

    @classmethod
    def name(cls) -> str:
        return "runfiles"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write_lines(lines: DataFrame, path: str, allowed: str, single: bool = False) -> None:
    """The one string column of `lines` as lines below the folder `allowed`."""
    check_target(path, allowed)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    lines.sparkSession.dataSource.register(RunFiles)
    lines.write.format("runfiles").option("allowed", allowed).option("single", str(single).lower()).mode("append").save(path)


def as_json(df: DataFrame) -> DataFrame:
    """(line): each row as a JSON object, nulls included."""
    every: list[Column] = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.to_json(F.struct(*every), {"ignoreNullFields": "false"}).alias("line"))
