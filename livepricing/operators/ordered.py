"""Skew-safe ordered scans: numbering, LAG and carry-forward (last non-NULL) within a key.

``Window.partitionBy(key).orderBy(ts)`` puts every row of a key into one task; a hot key
(a third of the rows) would stall there, and so would a hot second of it if the key were cut by
time. Here the rows are cut by their number:

1. the table is sorted by (key, order) over ranges from sampled quantiles and written once; a
   range is a block, so a hot key, a hot second of it and a hot tie are many blocks;
2. one summary row per (key, block): its count, its last value, its last non-NULL value (partial
   aggregates); a window over the summaries of a key (one row per block) carries in what the blocks
   before it hold;
3. a window over (key, block) finishes the rows.

The result is exactly the plain window's; only the unit of work changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

BLOCKS_PER_PARTITION = 4    # blocks per shuffle partition, so that blocks even out over tasks


def time_bucket(ts: str, width: str) -> Column:
    return F.window(F.col(ts), width).start


def in_blocks(df: DataFrame, key: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """``df`` written in (key, order), with ``_id`` ascending in it and ``_blk``, the block of the
    row. ``order`` must be total within a key."""
    n = blocks or BLOCKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*key, *order]
    s = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id())
    return stage_table(s, "in-order").withColumn("_blk", F.shiftright("_id", 33))


def before_block(key: Sequence[str]) -> Window:
    """The blocks of a key before the current one."""
    return Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_pos``, the number of each row (from 0) within its key."""
    key = list(key)
    d = in_blocks(df, key, order)
    per = d.groupBy(*key, "_blk").agg(F.min("_id").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    off = per.select(*key, "_blk", (F.coalesce(F.sum("_n").over(before_block(key)), F.lit(0)) - F.col("_lo")).alias("_off"))
    return d.join(off, [*key, "_blk"]).select(*df.columns, (F.col("_id") + F.col("_off")).alias("_pos"))


def running_sum(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` from the first row of its key up to each row."""
    key, order = list(key), list(order)
    d = in_blocks(df, key, order)
    per = d.groupBy(*key, "_blk").agg(F.sum(value).alias("_s"))
    off = per.select(*key, "_blk", F.coalesce(F.sum("_s").over(before_block(key)), F.lit(0)).alias("_off"))
    local = F.sum(value).over(Window.partitionBy(*key, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_local", local).join(off, [*key, "_blk"]).select(*df.columns, (F.col("_off") + F.col("_local")).alias(out))


def ordered_fill(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str,
                 prev_out: str | None = None, last_out: str | None = None,
                 prev_last_out: str | None = None) -> DataFrame:
    """Adds ``prev_out`` = LAG(value), ``last_out`` = LAST(value IGNORE NULLS) over
    (PARTITION BY key ORDER BY order ROWS UNBOUNDED PRECEDING) and ``prev_last_out`` = the
    same without the current row. ``order`` must be total within a key."""
    key, order = list(key), list(order)
    d = in_blocks(df, key, order)
    row = F.struct(*[F.col(c) for c in order], F.col(value).alias("_v"))
    summ = (d.groupBy(*key, "_blk")
            .agg(F.max(row).alias("_last_row"),
                 F.max(F.when(F.col(value).isNotNull(), row)).alias("_last_nn_row"))
            .select(*key, "_blk", F.col("_last_row._v").alias("_b_last"),
                    F.col("_last_nn_row._v").alias("_b_last_nn")))
    wb = Window.partitionBy(*key).orderBy("_blk")
    summ = summ.select(
        *key, "_blk",
        F.lag("_b_last").over(wb).alias("_in_prev"),
        F.last("_b_last_nn", ignorenulls=True).over(before_block(key)).alias("_in_last_nn"))
    joined = d.join(summ, key + ["_blk"])
    wr = Window.partitionBy(*key, "_blk").orderBy(*order)
    cols = [c for c in df.columns]
    out = joined
    if prev_out:
        out = out.withColumn(prev_out, F.when(F.row_number().over(wr) == 1, F.col("_in_prev"))
                             .otherwise(F.lag(value).over(wr)))
        cols.append(prev_out)
    if last_out:
        out = out.withColumn(last_out, F.coalesce(
            F.last(value, ignorenulls=True).over(wr.rowsBetween(Window.unboundedPreceding, 0)),
            F.col("_in_last_nn")))
        cols.append(last_out)
    if prev_last_out:
        out = out.withColumn(prev_last_out, F.coalesce(
            F.last(value, ignorenulls=True).over(wr.rowsBetween(Window.unboundedPreceding, -1)),
            F.col("_in_last_nn")))
        cols.append(prev_last_out)
    return out.select(*cols)
