"""Versioned Parquet snapshots with a commit marker written last.

Each version of each maintained table lives in ``<root>/<table>/v=<n>``; a version counts
only once ``<root>/commits/v=<n>`` exists, and readers pin the newest committed version,
so a reader never sees half of a micro-batch. Re-running a batch overwrites its own
version directories before committing again, which makes replays idempotent. The root
sits under the cluster's shared checkpoint folder.

A keyed table is kept as changes: version v holds the rows whose key changed in v (``_gone`` marks
a key that left), and the table at v is the newest row of each key in the last full copy, its base
(``full=<n>``), and the changes from there up to v. So what a version writes follows its changes and
not the table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str | None = None, name: str = "state"):
        self.spark = spark
        self.root = (root or scratch_path(spark, name)).rstrip("/")

    def path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v={version}"

    def write(self, table: str, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self.path(table, version))

    def commit(self, version: int, **meta) -> None:
        row = [(int(version), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
                ",".join(f"{k}={v}" for k, v in sorted(meta.items())))]
        (self.spark.createDataFrame(row, "version long, committed_at timestamp_ntz, meta string")
         .coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/v={version}"))

    # --- keyed tables as changes ------------------------------------------------------------

    def full_path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/full={version}"

    def write_changes(self, table: str, df: DataFrame, version: int, full: bool = False) -> None:
        """Rows of changed keys, with ``_gone``; or the whole table as a base for later versions."""
        path = self.full_path(table, version) if full else self.path(table, version)
        df.withColumn("_v", F.lit(version).cast("long")).write.mode("overwrite").parquet(path)

    def log(self, table: str, ddl: str, base: int, version: int) -> DataFrame:
        """All rows from the base up to ``version``."""
        paths = [self.full_path(table, base), *(self.path(table, v) for v in range(base + 1, version + 1))]
        return self.spark.read.schema(f"{ddl}, _gone boolean, _v long").parquet(*paths)

    def keyed(self, table: str, ddl: str, key: list[str], base: int, version: int, only: DataFrame | None = None,
              columns: list[str] | None = None) -> DataFrame:
        """A keyed table at ``version``: the newest row per key. ``only`` (some of the key columns)
        restricts it before anything is shuffled; so do ``columns`` (beside the key), which Spark
        cannot prune from the struct."""
        rows = self.log(table, ddl, base, version)
        if only is not None:
            rows = rows.join(only.distinct(), only.columns, "left_semi")
        rest = [c for c in rows.columns if c not in (*key, "_v") and (columns is None or c in (*columns, "_gone"))]
        newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*key, "_r.*")
        return newest.where(~F.col("_gone")).drop("_gone")

    def base_of(self, version: int) -> int:
        """The full version that ``version`` builds upon."""
        meta = self.commits().where(F.col("version") == version).select("meta").first()[0]
        return int(dict(x.split("=", 1) for x in meta.split(",")).get("base", version))

    def expire(self, keep: int) -> list[int]:
        """Delete the folders and commits of versions that none of the newest ``keep`` committed
        versions builds upon; any kept version stays readable. Returns the versions deleted."""
        done = sorted(r.version for r in self.commits().select("version").collect())
        if not done[:-keep]:
            return []
        first = min(self.base_of(v) for v in done[-keep:])
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        tables = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        old = [v for v in done if v < first]
        for v in old:   # the commit goes first: no reader can pin a version that is being deleted
            fs.delete(path(f"{self.root}/commits/v={v}"), True)
            for t in set(tables) - {"commits", "stream-checkpoint"}:
                fs.delete(path(self.path(t, v)), True)
                fs.delete(path(self.full_path(t, v)), True)
        return old

    def commits(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/commits")
        except AnalysisException:
            return None

    def latest(self) -> int | None:
        c = self.commits()
        if c is None:
            return None
        return c.agg(F.max("version")).first()[0]

    def is_committed(self, version: int) -> bool:
        c = self.commits()
        return c is not None and c.where(F.col("version") == version).limit(1).count() > 0

    def read(self, table: str, version: int | None = None) -> DataFrame:
        v = self.latest() if version is None else version
        if v is None:
            raise FileNotFoundError(f"no committed version under {self.root}")
        return self.spark.read.parquet(self.path(table, v))
