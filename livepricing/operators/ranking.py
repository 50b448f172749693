"""Skew-safe top-k and RANK() building blocks.

A plain ``rank().over(Window.partitionBy(g).orderBy(v))`` sends every row of a group to
one task, and a global rank sends the whole table to one task. These helpers never do:

* ``top_k_per_group`` - ``row_number() <= k``; Spark plans a partial ``WindowGroupLimit``
  before the shuffle, so a hot group moves at most k rows per map partition.
* ``top_k_rank`` - exact SQL RANK for every row whose rank is <= k (NULL otherwise): the
  k largest values *with multiplicity* of a group hold every value that has rank <= k,
  and a value's rank is 1 + the number of those k rows that are strictly larger.
* ``full_rank`` - exact SQL RANK for every row: a value histogram (partial aggregate),
  split into quantile buckets per group, then per-bucket prefix sums plus per-group bucket
  offsets. No window ever sees more than one bucket of distinct values, or more than
  ``buckets`` bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _q(c: str) -> str:
    return f"`{c}`"


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column] | str, k: int,
                    rn: str = "_rn") -> DataFrame:
    """Rows with row_number() <= k per group. ``order`` is either Columns or SQL order text
    (one JVM call for the whole window instead of one per node)."""
    if isinstance(order, str):
        part = f"PARTITION BY {', '.join(_q(g) for g in group)} " if group else ""
        return (df.selectExpr("*", f"row_number() OVER ({part}ORDER BY {order}) AS {_q(rn)}")
                .where(f"{_q(rn)} <= {int(k)}"))
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)


def top_k_rank(df: DataFrame, group: Sequence[str], value: str, k: int, out: str) -> DataFrame:
    """Adds ``out`` = RANK() OVER (PARTITION BY group ORDER BY value DESC) where it is <= k,
    NULL where it is larger. Bounded: at most k rows per group are ranked."""
    group = list(group)
    vals = df.select(*group, value).where(f"{_q(value)} IS NOT NULL")
    if group:
        cols = ", ".join(_q(g) for g in group)
        top = top_k_per_group(vals, group, f"{_q(value)} DESC", k)
        ranked = top.selectExpr(
            *[_q(g) for g in group], _q(value),
            f"rank() OVER (PARTITION BY {cols} ORDER BY {_q(value)} DESC) AS {_q(out)}").distinct()
        # one row per (group, top value); at most k per group, sized by AQE at runtime
        return df.join(ranked, group + [value], "left")
    # global: TakeOrdered keeps k rows per partition, then k rows in total
    top = vals.orderBy(F.col(value).desc()).limit(k)
    ranked = top.withColumn(out, F.rank().over(Window.orderBy(F.col(value).desc()))).distinct()
    # at most k rows: broadcasting is bounded by construction
    return df.join(F.broadcast(ranked), [value], "left")


def full_rank(df: DataFrame, group: Sequence[str], value: str, out: str,
              buckets: int | None = None) -> DataFrame:
    """Adds ``out`` = RANK() OVER (PARTITION BY group ORDER BY value DESC) for every row.
    Rows with a NULL value get a NULL rank. ``buckets`` (of distinct values, per group)
    follows the session's shuffle partitions, which are sized from the input; any number
    gives the same ranks."""
    group = list(group)
    if buckets is None:
        buckets = min(max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 4096)
    hist = (df.where(F.col(value).isNotNull())
            .groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n")))
    fractions = [i / buckets for i in range(1, buckets)]
    bounds = hist.groupBy(*group).agg(
        F.percentile_approx(value, fractions, max(10_000, 16 * buckets)).alias("_bounds"))
    if group:
        hb = hist.join(bounds, group)
    else:
        # one row of at most ``buckets`` numbers: a scalar subquery
        hb = hist.withColumn("_bounds", bounds.select("_bounds").scalar())
    # bucket 0 holds the largest values
    hb = hb.withColumn("_b", F.size(F.filter("_bounds", lambda b: b > F.col(value)))).drop("_bounds")
    local = hb.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*group, "_b").orderBy(F.col(value).desc())
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_bucket = hb.groupBy(*group, "_b").agg(F.sum("_n").alias("_bn"))
    offsets = per_bucket.withColumn("_off", F.coalesce(F.sum("_bn").over(
        Window.partitionBy(*group).orderBy("_b")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_bn")
    keyed = (local.join(offsets, group + ["_b"])
             .select(*group, value, (F.col("_off") + F.col("_before") + 1).cast("int").alias(out)))
    return df.join(keyed, group + [value], "left")
