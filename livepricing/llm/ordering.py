"""Global order without a global window: rows dealt by range, sorted within their ranges and
written once, with ids that ascend in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

PART_BITS = 33  # monotonically_increasing_id: the partition stands above these bits


def sorted_rows(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` written in ascending ``order`` (nulls first), with ``_id`` ascending in it. Equal
    rows are dealt apart by a number of their own, so a great many copies are no single task."""
    d = df.withColumn("_salt", F.monotonically_increasing_id())
    d = d.repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    return scratch.stage(d.drop("_salt").withColumn("_id", F.monotonically_increasing_id()), name)


def positions(df: DataFrame, group: list[str], order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``pos``, the place of each row (from 0) within its group in ascending ``order``.
    One count per group and range gives each range its offset; windows see these counts only.
    Null is a group of its own."""
    rows = sorted_rows(df, [*group, *order], scratch, name).withColumn("_part", F.shiftright("_id", PART_BITS))
    per = rows.groupBy(*group, "_part").agg(F.min("_id").alias("_lo"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    off = per.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"),
                     (F.coalesce(before, F.lit(0)) - F.col("_lo")).alias("_off"))
    on = F.col("_part") == F.col("_p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return rows.join(off, on).select(*df.columns, (F.col("_id") + F.col("_off")).alias("pos"))
