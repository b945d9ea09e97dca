"""Folder walks, level by level.

A table of folders is listed in tasks, one folder at a time; the folders found form the next level's table. Hidden folders
and those below the depth limit never enter a table, so nothing in them is listed. The driver starts one job a level and
sees counts only. A task holds the entries of one folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sources import files
from millrace.storage import Workspace, scratch

#: Folders that a task lists, entries that it hands on at once.
FOLDERS_A_TASK, ENTRIES = 100, 10_000
_COLUMNS = ["rel", "kind", "length", "millis"]
_SCHEMA = "rel string, kind string, length bigint, millis bigint"


def entries(folders: DataFrame, root: str) -> DataFrame:
    """What the folders ``rel`` below ``root`` hold: rows of kind ``file`` and ``folder`` without hidden ones, and of each
    folder one row ``listed`` (``length``: number of entries, hidden ones too) or ``failed``."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {pa.fs.FileType.File: "file", pa.fs.FileType.Directory: "folder"}
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                try:
                    system, base = files.place(root.rstrip("/") + "/" + rel if rel else root)
                    found = system.get_file_info(pa.fs.FileSelector(base))
                except files.UNREADABLE:
                    yield batch_of([(rel, "failed", None, None)])
                    continue
                rows = [(rel, "listed", len(found), None)]
                for x in found:
                    if x.type in kinds and not x.base_name.startswith("."):
                        rows.append((f"{rel}/{x.base_name}" if rel else x.base_name, kinds[x.type], x.size, None if x.mtime_ns is None else x.mtime_ns // 1_000_000))
                    if len(rows) >= ENTRIES:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    return folders.select("rel").mapInArrow(run, _SCHEMA)


def levels(spark: SparkSession, root: str, max_depth: int, enough: Callable[[DataFrame], bool] | None = None, ws: Workspace | None = None) -> list[DataFrame]:
    """The entries of each level, the root's first, down to ``max_depth`` levels below it. ``enough`` is asked after each
    level with the entries so far, and ends the walk where true."""
    ws = scratch(spark, "walk", ws)
    out: list[DataFrame] = []
    folders, n = spark.createDataFrame([("",)], "rel string"), 1
    while n and len(out) <= max_depth:
        out.append(ws.save(entries(folders.repartition(-(-n // FOLDERS_A_TASK)), root), f"level-{len(out)}"))
        folders = out[-1].where("kind = 'folder'")
        n = folders.count() if len(out) <= max_depth else 0
        if n and enough and enough(whole(out)):
            break
    return out


def whole(found: list[DataFrame]) -> DataFrame:
    """The entries of all levels."""
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def files_below(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """``uri, rel, length, millis, mime`` of the files among entries."""
    address = root if ":" in root.split("/", 1)[0] else "file:" + root
    return found.where("kind = 'file'").select(F.concat(F.lit(address.rstrip("/") + "/"), "rel").alias("uri"), "rel", "length", "millis", F.lit(None).cast("string").alias("mime"))


def breadth_first(rel: str = "rel") -> list:
    """Sort keys: the order in which a breadth-first walk meets files, folders and files by name."""
    parts = F.split(rel, "/")
    return [F.size(parts), F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)]
