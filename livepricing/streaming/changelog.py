"""Changes of all tables in one order: a changelog with transaction numbers and a commit frontier.

A transaction is numbered (``txn``, without gaps) and consists of change records of any tables and
one end record that tells how many they are. Records may come in any order, in pieces and more than
once. The frontier is the last transaction up to which all are complete; a version of the views
holds exactly the transactions up to its frontier, so no reader sees half of one, in one table or
across tables. What lies beyond waits in the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .maintained import CHANGES, MaintainedViews

END = "end"


def to_changelog(changes: dict[str, DataFrame], transactions: DataFrame) -> DataFrame:
    """Change records (txn, part, kind, size, one struct column per kind) of ``changes``, whose
    ``seq`` is their transaction, and an end record for each row of ``transactions`` (txn)."""
    log = None
    for kind, df in changes.items():
        body = F.struct(*df.columns)
        # equal changes of one transaction are told apart by their place in it
        place = F.row_number().over(Window.partitionBy("txn", "kind").orderBy(kind)).cast("long")
        part = df.select(F.col("seq").cast("long").alias("txn"), F.lit(kind).alias("kind"), body.alias(kind)).withColumn("part", place)
        log = part if log is None else log.unionByName(part, allowMissingColumns=True)
    sizes = log.groupBy("txn").agg(F.count("*").alias("size"))
    ends = transactions.select(F.col("txn").cast("long").alias("txn")).join(sizes, "txn", "left").select(
        "txn", F.lit(END).alias("kind"), F.lit(0).cast("long").alias("part"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    return log.unionByName(ends, allowMissingColumns=True)


def frontier_of(records: DataFrame, done: int) -> int:
    """The last transaction after ``done`` up to which all are complete. Ends of complete runs are
    found by a join with the next number, so no window spans the transactions."""
    is_end = F.col("kind") == END
    whole = (records.groupBy("txn").agg(F.max(F.when(is_end, F.col("size"))).alias("size"), F.count(F.when(~is_end, 1)).alias("got"))
             .where("size = got").select("txn"))
    known = whole.union(records.sparkSession.createDataFrame([(done,)], "txn long"))
    following = whole.select((F.col("txn") - 1).alias("txn"))
    return known.join(following, "txn", "left_anti").agg(F.min("txn")).first()[0]


class Replay:
    """Applies a changelog to maintained views, whole transactions only."""

    def __init__(self, views: MaintainedViews, records_schema, first: int):
        """``first``: the number of the first transaction there is."""
        self.views, self.schema, self.first = views, records_schema, first

    def _pending(self, version: int) -> str:
        return self.views.store.path("pending", version)

    def frontier(self, version: int | None = None) -> int:
        store = self.views.store
        v = store.latest() if version is None else version
        meta = store.commits().where(F.col("version") == v).select("meta").first()[0]
        return int(dict(x.split("=", 1) for x in meta.split(",")).get("frontier", self.first - 1))

    def apply(self, records: DataFrame, version: int) -> int:
        """Take in a batch of records as ``version``; returns its frontier."""
        spark, store = self.views.spark, self.views.store
        done = self.frontier(version - 1)
        if version > 1:
            records = records.unionByName(spark.read.schema(self.schema).parquet(self._pending(version - 1)))
        fresh = records.where(F.col("txn") > done).dropDuplicates(["txn", "kind", "part"])
        held = spark.read.schema(self.schema).parquet(self._hold(fresh, version))
        upto = frontier_of(held, done)
        ready = stage_table(held.where(F.col("txn") <= upto), "ready-changes")
        held.where(F.col("txn") > upto).write.mode("overwrite").parquet(self._pending(version))
        kinds = [k for k in CHANGES if k in ready.columns]
        self.views.apply({k: ready.where(F.col("kind") == k).select(f"{k}.*") for k in kinds}, version, frontier=upto)
        return upto

    def _hold(self, df: DataFrame, version: int) -> str:
        path = self.views.store.path("arrived", version)
        df.write.mode("overwrite").parquet(path)
        return path
