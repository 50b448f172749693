"""The trailing rate kept up to date over a stream, exact for any split into batches.

A sample's rate counts the samples of its source in the second up to it, so a new sample changes
its own rate and those of the second after it. Samples are logged with the whole second (cell) they
fall into; a batch counts again the samples of its cells and of the cells after them, from the log
of these cells and the ones before, and writes the rates that differ. A late sample does the same as
any other: nothing is dropped by age and no state is held per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import QPS_WINDOW_SECONDS, trailing_qps
from ..session import stage_table
from .store import SnapshotStore

KEY = ["source", "ts", "seq"]
SAMPLE = "source string, ts timestamp_ntz, seq long, cell long"
RATE = "source string, ts timestamp_ntz, seq long, queries long, qps double"


def cell_of(ts):
    return F.floor(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts) / F.lit(int(QPS_WINDOW_SECONDS * 1_000_000)))


class TrailingRate:
    def __init__(self, spark: SparkSession, store: SnapshotStore, compact_every: int = 16):
        self.spark, self.store, self.compact_every = spark, store, compact_every
        if store.latest() is None:
            for table, ddl in (("samples", SAMPLE), ("rate", RATE)):
                store.write_changes(table, spark.createDataFrame([], f"{ddl}, _gone boolean"), 0, full=True)
            store.commit(0, base=0, kind="empty")

    def read(self, version: int | None = None) -> DataFrame:
        v = self.store.latest() if version is None else version
        return self.store.keyed("rate", RATE, KEY, self.store.base_of(v), v)

    def apply(self, arrived: DataFrame, version: int, **meta) -> None:
        """``arrived``: source, ts, seq; (source, ts, seq) names a sample, one that comes again is the
        same sample."""
        store, base = self.store, self.store.base_of(version - 1)
        known = store.keyed("samples", SAMPLE, KEY, base, version - 1, arrived.select(*KEY))
        new = arrived.select(*KEY).distinct().join(known.select(*KEY), KEY, "left_anti").withColumn("cell", cell_of(F.col("ts")))
        store.write_changes("samples", new.withColumn("_gone", F.lit(False)), version)
        cells = stage_table(self.spark.read.schema(SAMPLE).parquet(store.path("samples", version)).select("source", "cell").distinct(), "touched-cells")
        touched = cells.select("source", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell")).distinct()
        needed = cells.select("source", F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("cell"))
        samples = store.keyed("samples", SAMPLE, KEY, base, version, needed)
        # the cells before the touched ones only serve to count
        rates = trailing_qps(samples).withColumn("cell", cell_of(F.col("ts"))).join(touched, ["source", "cell"], "left_semi").drop("cell")
        old = store.keyed("rate", RATE, KEY, base, version - 1, rates.select(*KEY)).select(*KEY, F.col("queries").alias("was"))
        changed = rates.join(old, KEY, "left").where("was IS NULL OR was <> queries").drop("was")
        store.write_changes("rate", changed.withColumn("_gone", F.lit(False)), version)
        if version - base >= self.compact_every:
            for table, ddl in (("samples", SAMPLE), ("rate", RATE)):
                store.write_changes(table, store.keyed(table, ddl, KEY, base, version).withColumn("_gone", F.lit(False)), version, full=True)
            base = version
        store.commit(version, base=base, **meta)
