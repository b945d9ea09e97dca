"""Shared intermediate tables.

Lineage is cut by writing Parquet below the folder that the session names in ``spark.checkpoint.dir``: every
executor sees that folder, so a lost executor costs a retry of its tasks and nothing else. Only a session that runs in
one process may do without that setting; it gets a temporary folder that goes with the process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the workspaces of this process that still exist.
_OPEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", "")
        if not configured:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


class Workspace:
    """A folder of intermediate tables that belongs to one operator run."""

    def __init__(self, spark: SparkSession, label: str = "work"):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n, self._live = 0, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        _OPEN.add(self.root)
        saved = self.spark.read.schema(schema).parquet(path)
        saved._millrace_path = path
        self._live[path] = saved
        return saved

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in frames:
            if self._live.pop(df._millrace_path, None) is not None:
                _delete(self.spark, df._millrace_path)

    def child(self, label: str) -> Workspace:
        """A workspace below this one, for an operator that drops its own tables."""
        made = Workspace.__new__(Workspace)
        self._n += 1
        made.spark, made.root, made._n, made._live = self.spark, f"{self.root}/{self._n:03d}-{label}", 0, {}
        return made

    def keep(self, *frames: DataFrame) -> None:
        """Delete every table of this workspace but those that the operator's result still reads."""
        kept = {df._millrace_path for df in frames}
        self.drop(*[df for path, df in list(self._live.items()) if path not in kept])

    def close(self) -> None:
        """Delete the folder: after the operator's result has been written elsewhere."""
        _delete(self.spark, self.root)
        self._live.clear()
        _OPEN.discard(self.root)


def scratch(spark: SparkSession, label: str, workspace: Workspace | None = None) -> Workspace:
    """A workspace of one operator: below the given one, else of its own."""
    return workspace.child(label) if workspace else Workspace(spark, label)


def close_all(spark: SparkSession) -> None:
    """Delete what every workspace of this process still holds, at the end of a job."""
    for root in list(_OPEN):
        _delete(spark, root)
        _OPEN.discard(root)
