"""Project folders as a Spark data source: folders are walked by tasks, files are read by tasks.

Spark's own file sources leave out files whose names start with an underscore, which projects use; hence this one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.tables import numbered

# What a scan reads and what it leaves out.
EXTENSIONS = (".sql", ".yml", ".yaml", ".csv")
SKIPPED_FOLDERS = {".git", ".venv", "__pycache__", "dbt_packages", "logs", "node_modules", "target"}
#: Largest file that a scan reads unless told otherwise.
MOST_BYTES = 2_000_000
#: Folders that the driver opens to find subtrees for tasks; bytes of text that a task holds before it hands them on.
OPENED, HELD_BYTES = 16, 32_000_000
READ = pa.schema([("project", pa.string()), ("path", pa.string()), ("text", pa.string()), ("scan_ord", pa.int64())])


def entered(folder: str) -> list[str]:
    """Paths of the folders right below one that a scan goes into, sorted."""
    with os.scandir(folder) as found:
        return sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and e.name not in SKIPPED_FOLDERS)


def top_folders(root: str) -> list[str]:
    """Folders right below root that a scan would enter, sorted."""
    return [os.path.basename(p) for p in entered(root)] if os.path.isdir(root) else []


def inside(path: str, root: str) -> str | None:
    """The path relative to root with / between its parts; null if it lies outside."""
    path, root = os.path.abspath(path), os.path.abspath(root)
    return os.path.relpath(path, root).replace(os.sep, "/") if os.path.commonpath([path, root]) == root else None


class _Subtrees(InputPartition):
    """Folders to list: with all below them (deep), or only their own files."""

    def __init__(self, folders: list[str], deep: bool):
        self.folders, self.deep = folders, deep


class _Listing(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.project = options["path"], options.get("project", "base")
        self.include = [f for f in options.get("include", "").split("\n") if f]

    def partitions(self) -> list[_Subtrees]:
        starts = [os.path.join(self.root, f) for f in self.include] if self.include else [self.root]
        to_open = sorted({os.path.abspath(p) for p in starts if inside(p, self.root) and os.path.isdir(p)})
        opened = []
        while to_open and len(opened) < OPENED:
            opened.append(to_open.pop(0))
            to_open += entered(opened[-1])
        return [_Subtrees(opened, False), *[_Subtrees([p], True) for p in to_open]]

    def read(self, part: _Subtrees) -> Iterator[tuple]:
        todo = list(part.folders)
        while todo:
            folder = todo.pop()
            if part.deep:
                todo += entered(folder)
            above = inside(folder, self.root)
            with os.scandir(folder) as found:
                for e in found:
                    if not e.name.startswith(".") and e.name.lower().endswith(EXTENSIONS) and not e.is_dir():
                        link = e.is_symlink()
                        yield self.project, e.name if above == "." else f"{above}/{e.name}", 0 if link else e.stat().st_size, link


class ProjectFiles(DataSource):
    """format("projectfiles"), options path, project, include (folders, one a line): rows (project, path, bytes, link) of the files there; nothing is opened."""

    @classmethod
    def name(cls) -> str:
        return "projectfiles"

    def schema(self) -> str:
        return "project string, path string, bytes long, link boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options)


def listing(spark: SparkSession, root: str, project: str, include: list[str] | None = None, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """(project, path, bytes, left_out): the files of a project, each once; left_out is link, size, or null where the file is read."""
    spark.dataSource.register(ProjectFiles)
    found = spark.read.format("projectfiles").option("project", project).option("include", "\n".join(include or [])).load(os.path.abspath(root))
    size = F.lit(False) if most_bytes is None else F.col("bytes") > most_bytes
    return found.select("project", "path", "bytes", F.when(F.col("link"), "link").when(size, "size").alias("left_out")).distinct()


def left_out(spark: SparkSession, root: str, project: str, include: list[str] | None = None, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """(project, left_out, n, bytes): what a scan does not read, by reason."""
    return listing(spark, root, project, include, most_bytes).where("left_out is not null").groupBy("project", "left_out").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def read_project(spark: SparkSession, root: str, project: str, include: list[str] | None = None, most_bytes: int | None = MOST_BYTES, most_files: int | None = None) -> DataFrame:
    """(project, path, text, scan_ord): texts of the files in the order of their paths, numbered by ranges; line ends as \\n, undecodable bytes replaced.

    Links and files over most_bytes are not read (left_out() counts them); of the others all, or the first most_files.
    """
    rows = numbered(listing(spark, root, project, include, most_bytes).where("left_out is null").select("project", "path"), ["path"], "scan_ord", "files")
    if most_files is not None:
        rows = rows.where(F.col("scan_ord") < most_files)

    root = os.path.abspath(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                with open(os.path.join(root, r["path"]), encoding="utf-8", errors="replace", newline=None) as f:
                    r["text"] = f.read()
                rows.append(r)
                size += len(r["text"])
                if size > HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, READ)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, READ)

    return rows.select("project", "path", "scan_ord").mapInArrow(read, "project string, path string, text string, scan_ord long")
