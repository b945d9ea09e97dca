"""Structured Streaming front end: each micro-batch of listings is merged into the stored catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.snapshot import first_per_id, merge_snapshot
from millrace.storage import Workspace

#: Buckets that ids are dealt out to; a store keeps the number that it was made with.
BUCKETS = 256


class Catalogue:
    """A catalogue folder whose rows lie in buckets by the hash of their id.

    A version holds the buckets that one batch names, and counts once its marker exists; of each bucket the latest version
    is read. So a batch reads and writes its own buckets only, and a write that was cut short is never read. Buckets that
    neither the current nor the previous state reads are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _listed(self, *below: str) -> list:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *below)))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, *below: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *below)))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def versions(self) -> dict[int, set[int]]:
        """The buckets of each complete version."""
        out = {}
        for name in self._listed():
            if name.startswith("v") and name[1:].isdigit():
                inside = self._listed(name)
                if "_SUCCESS" in inside:
                    out[int(name[1:])] = {int(x.split("=")[1]) for x in inside if x.startswith("part=")}
        return out

    @staticmethod
    def state(versions: dict[int, set[int]], until: int | None = None) -> dict[int, int]:
        """The version in which each bucket is read, with versions up to ``until``."""
        return {b: v for v in sorted(versions) if until is None or v <= until for b in versions[v]}

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        at = {b: v for b, v in self.state(self.versions()).items() if buckets is None or b in buckets}
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/v{v}/part={b}" for b, v in sorted(at.items())])

    def upsert(self, listing: DataFrame) -> None:
        """Merge a listing without dropping rows that it doesn't mention."""
        self._change(first_per_id(listing), lambda stored, fresh: merge_snapshot(stored, fresh).drop("outcome"))

    def put(self, rows: DataFrame) -> None:
        """Take whole rows in place of those of their ids, as after hashing; one row an id."""
        self._change(rows, lambda stored, fresh: stored.join(fresh.select("id"), "id", "left_anti").select(*stored.columns).unionByName(fresh))

    def _change(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        part = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        ws = Workspace(self.spark, "batch")
        fresh = ws.save(rows, "fresh")
        touched = {r[0] for r in fresh.select(part).distinct().collect()}
        if touched:
            before = self.versions()
            new = max([int(x[1:]) for x in self._listed() if x.startswith("v") and x[1:].isdigit()], default=0) + 1
            merged = change(self.read(touched), fresh).withColumn("part", part)
            merged.repartition(len(touched), "part").write.partitionBy("part").parquet(f"{self.path}/v{new}")
            self._tidy(before | {new: touched})
        ws.close()

    def _tidy(self, versions: dict[int, set[int]]) -> None:
        last = sorted(versions)[-2:]
        used = {(v, b) for until in last for b, v in self.state(versions, until).items()}
        for v, held in versions.items():
            gone = {b for b in held if (v, b) not in used}
            if gone == held:
                self._delete(f"v{v}")
            else:
                for b in gone:
                    self._delete(f"v{v}", f"part={b}")


def follow(listings: DataFrame, catalogue: Catalogue, checkpoint: str):
    """Start a query that merges every micro-batch; replays are idempotent, as equal rows are only touched."""
    return listings.writeStream.foreachBatch(lambda df, _: catalogue.upsert(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts by window and kind over an event stream; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
