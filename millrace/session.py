"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of rows that a task hands to Python at once, in place of Spark's default: a batch is held on both sides.
BATCH, _BATCH_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started, and take rows in small batches; idempotent.

    Workers get the repository's folder on their path. A cluster whose nodes lack that folder gets the package with
    ``--py-files`` or an installed wheel as usual. A batch size that the session sets itself is left alone.
    """
    if spark.conf.get(_BATCH_BYTES, None) == "67108864b":
        spark.conf.set(_BATCH_BYTES, str(BATCH))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    base = {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    }
    return ship(builder.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate())
