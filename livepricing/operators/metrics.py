"""Freshness, rate and latency metrics over a flat stream of samples.

A sample is (source, ts, latency seconds, seq). The reference keeps at most the last 100
latency samples per source, counts queries over a trailing second, gates every metric on
the age of the last sample and derives replication lag from heartbeats. All of it is
expressed here as aggregates and bounded windows; ``as_of`` (the "now") is always an
explicit column or literal so results are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered, ordered_fill, running_sum, time_bucket
from .ranking import top_k_per_group

# Fixed values that must equal the reference's for the same results.
KEEP_SAMPLES = 100            # latency samples kept per source
P99_MIN_SAMPLES = 100         # below this many samples p99 is the max
QPS_WINDOW_SECONDS = 1.0      # trailing window of the rate
QUERY_STALE_SECONDS = 2.0     # query metrics are NULL when the last sample is older
RESOURCE_STALE_SECONDS = 10.0 # resource metrics likewise
HISTORY_SECONDS = 180         # charts keep 3 minutes ...
HISTORY_POINTS = 180          # ... and at most 180 points
ASSUMED_MEMORY_GB = 4.0       # memory chart scales percent to GB with this size
LAG_BANDS = ((1.0, "Low"), (5.0, "Medium"))   # below 1 s Low, below 5 s Medium, else High
PIPELINE_FLOOR_MS, PIPELINE_BASE_MS, PIPELINE_TAIL_MS, PIPELINE_DEFAULT_MS = 70, 20, 115, 185


def seconds_between(later: Column, earlier: Column) -> Column:
    """EXTRACT(EPOCH FROM later - earlier) as DOUBLE seconds (microsecond exact). Computed
    on the values themselves, so TIMESTAMP_NTZ inputs do not depend on the session zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def ms_exact(latency_s: Column) -> Column:
    """Latency seconds -> milliseconds as an exact decimal (sums do not depend on order)."""
    return (latency_s * 1000).cast("decimal(38,6)")


def last_samples(samples: DataFrame, n: int = KEEP_SAMPLES) -> DataFrame:
    """The last n samples of every source (bounded per source before the shuffle)."""
    return top_k_per_group(samples, ["source"], [F.col("ts").desc(), F.col("seq").desc()], n,
                           rn="recency")


def _statistics(values: dict[str, Column]) -> list[Column]:
    """Aggregates behind `statistics_struct`: exact sum, and the sorted values (at most
    KEEP_SAMPLES per group, the callers bound them). NULL values are left out."""
    return [c for name, v in values.items()
            for c in (F.sum(v).alias(f"_{name}_sum"), F.sort_array(F.collect_list(v)).alias(f"_{name}"))]


def statistics_struct(name: str) -> Column:
    """(max, average, p99) of a sorted list made by `_statistics`; NULL without values. p99 is
    the 0-based order statistic int(0.99 * count) from P99_MIN_SAMPLES values on, else the max."""
    n, top = F.size(f"_{name}"), F.element_at(f"_{name}", -1)
    p99 = F.when(n >= P99_MIN_SAMPLES, F.element_at(f"_{name}", F.floor(n * 0.99).cast("int") + 1)).otherwise(top)
    return F.when(n > 0, F.struct(top.cast("double").alias("max"),
                                  (F.col(f"_{name}_sum").cast("double") / n).alias("average"),
                                  p99.cast("double").alias("p99")))


def _in_last_second() -> Column:
    """Whether a kept sample lies within the trailing second of its source's newest sample
    (over `last_samples`, so the window sees at most KEEP_SAMPLES rows)."""
    newest = F.max("ts").over(Window.partitionBy("source"))
    return seconds_between(newest, F.col("ts")) <= QPS_WINDOW_SECONDS


def latency_stats(samples: DataFrame, n: int = KEEP_SAMPLES) -> DataFrame:
    """A13 with the eviction rule S19: max, average and p99 (ms) of the samples within the
    trailing second of the source's newest sample, the newest n at most."""
    kept = last_samples(samples, n).withColumn("_ms", F.when(_in_last_second(), ms_exact(F.col("latency"))))
    agg = kept.groupBy("source").agg(F.count("_ms").alias("samples"), *_statistics({"ms": F.col("_ms")}))
    st = statistics_struct("ms")
    return agg.select("source", "samples", st["max"].alias("max_ms"), st["average"].alias("avg_ms"),
                      st["p99"].alias("p99_ms"))


def last_n_stats(samples: DataFrame, n: int = KEEP_SAMPLES) -> DataFrame:
    """A13 without eviction by time, as for end-to-end latencies: max, average and p99 (ms)
    over the last n samples of a source."""
    kept = last_samples(samples, n).withColumn("_ms", ms_exact(F.col("latency")))
    agg = kept.groupBy("source").agg(F.count("_ms").alias("samples"), *_statistics({"ms": F.col("_ms")}))
    st = statistics_struct("ms")
    return agg.select("source", "samples", st["max"].alias("max_ms"), st["average"].alias("avg_ms"),
                      st["p99"].alias("p99_ms"))


def trailing_qps(samples: DataFrame) -> DataFrame:
    """At every sample, the samples of its source in the trailing second (itself included;
    of equal times, those with a smaller seq) over that second. Within the window the span
    never exceeds it, so max(1 s, span) is the window.

    The count is a difference of two running counts: up to the sample, and up to the start of its
    second. The starts are sorted in among the samples as rows of their own, so both come from one
    sum in blocks of rows, and a second that holds a third of all samples is many blocks."""
    back = int(QPS_WINDOW_SECONDS * 1_000_000)
    us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("ts"))
    d = samples.select("source", "ts", "seq", us.alias("_at"))
    rows = d.withColumn("_is_sample", F.lit(1).cast("long"))
    starts = d.withColumn("_at", F.col("_at") - back).withColumn("_is_sample", F.lit(0).cast("long"))
    run = running_sum(rows.unionByName(starts), ["source"], ["_at", "_is_sample", "seq"], "_is_sample", "_run")
    sample = F.col("_is_sample") == 1
    out = run.groupBy("source", "ts", "seq").agg(
        (F.max(F.when(sample, F.col("_run"))) - F.max(F.when(~sample, F.col("_run")))).alias("queries"))
    return out.select("source", "ts", "seq", "queries", (F.col("queries") / F.lit(QPS_WINDOW_SECONDS)).alias("qps"))


def rolling_stats(samples: DataFrame, n: int = KEEP_SAMPLES, block: int = 100_000) -> DataFrame:
    """W5 as a running frame: at every sample, count, max, average and p99 (ms) of the last n
    samples of its source. Rows are numbered per source and cut into runs of ``block`` rows; the
    last n - 1 rows of a run are also sent to the next one."""
    if n > P99_MIN_SAMPLES:
        raise ValueError(f"the p99 of a running frame is its max for n <= {P99_MIN_SAMPLES} only")
    pos = numbered(samples.select("source", "ts", "seq", ms_exact(F.col("latency")).alias("_ms")), ["source"], ["ts", "seq"])
    own = F.floor(F.col("_pos") / F.lit(block))
    pos = pos.withColumn("_own", own).withColumn("_bk", F.explode(F.sequence(own, F.floor((F.col("_pos") + n - 1) / F.lit(block)))))
    frame = Window.partitionBy("source", "_bk").orderBy("_pos").rowsBetween(-(n - 1), 0)
    out = pos.select("source", "ts", "seq", "_bk", "_own", F.count("_ms").over(frame).alias("samples"),
                     F.max("_ms").over(frame).alias("_max"), F.sum("_ms").over(frame).alias("_sum"))
    top = F.col("_max").cast("double")
    return out.where("_bk = _own").select("source", "ts", "seq", "samples", top.alias("max_ms"),
                                          (F.col("_sum").cast("double") / F.col("samples")).alias("avg_ms"),
                                          top.alias("p99_ms"))


def qps(samples: DataFrame, window: str = "1 second") -> DataFrame:
    """Per source and tumbling window, count / max(1 s, span of the window's samples).
    A partial aggregate: a hot source is pre-aggregated before the shuffle."""
    agg = (samples.groupBy("source", time_bucket("ts", window).alias("window_start"))
           .agg(F.count(F.lit(1)).alias("queries"), F.min("ts").alias("_t0"), F.max("ts").alias("_t1")))
    span = F.greatest(F.lit(QPS_WINDOW_SECONDS), seconds_between(F.col("_t1"), F.col("_t0")))
    return agg.select("source", "window_start", "queries", (F.col("queries") / span).alias("qps"))


def history_window(samples: DataFrame, seconds: int = HISTORY_SECONDS,
                   points: int = HISTORY_POINTS) -> DataFrame:
    """Per source, samples of the last `seconds` before its newest sample, at most
    `points` of them (newest first)."""
    # the newest `points` hold every row that can stay; the cut is then taken within them
    kept = top_k_per_group(samples, ["source"], [F.col("ts").desc(), F.col("seq").desc()], points, rn="point")
    newest = F.max("ts").over(Window.partitionBy("source"))
    return (kept.withColumn("_newest", newest)
            .where(F.col("ts") >= F.col("_newest") - F.expr(f"INTERVAL {int(seconds)} SECONDS"))
            .select("source", "ts", "latency", "point"))


def price_series(samples: DataFrame) -> DataFrame:
    """A per-consumer price series: the sample value, missing (NULL) on error samples."""
    return samples.select("user_id", "ts", "seq",
                          F.when(F.col("source") != "error", F.col("latency")).alias("price"))


def carry_forward(series: DataFrame) -> DataFrame:
    """Each row's last known price (NULLs carried forward) within its consumer."""
    return ordered_fill(series, ["user_id"], ["ts", "seq"], "price", last_out="price_filled")


def price_changes(series: DataFrame) -> DataFrame:
    """Previous price and a null-safe change flag per row of each consumer's series."""
    # the previous filled price is the last known one before the row: one pass gives both
    out = ordered_fill(series, ["user_id"], ["ts", "seq"], "price",
                       last_out="price_filled", prev_last_out="prev_price")
    return out.select("user_id", "ts", "seq", "price_filled", "prev_price",
                      (~F.col("price_filled").eqNullSafe(F.col("prev_price"))).alias("changed"))


def lag_band(lag_seconds: Column) -> Column:
    """NULL -> Unknown, < 1 s Low, < 5 s Medium, else High."""
    out = F.when(lag_seconds.isNull(), F.lit("Unknown"))
    for limit, label in LAG_BANDS:
        out = out.when(lag_seconds < limit, F.lit(label))
    return out.otherwise(F.lit("High"))


def source_gaps(samples: DataFrame) -> DataFrame:
    """Seconds since the previous sample of the same source, banded (P14 over W9)."""
    prev = ordered_fill(samples.select("source", "ts", "seq"), ["source"], ["ts", "seq"], "ts", prev_out="prev_ts")
    gap = seconds_between(F.col("ts"), F.col("prev_ts"))
    return prev.select("source", "ts", "seq", gap.alias("gap_seconds"), lag_band(gap).alias("band"))


def as_of_latest(samples: DataFrame) -> DataFrame:
    """A one-row 'now': the newest sample time (reproducible stand-in for NOW())."""
    return samples.agg(F.max("ts").alias("as_of"))


def freshness_gate(samples: DataFrame, stale_after: float = QUERY_STALE_SECONDS) -> DataFrame:
    """Per source, the last sample's latency, NULL when that sample is older than
    `stale_after` seconds at as_of (the newest sample overall)."""
    last = samples.groupBy("source").agg(
        F.max("ts").alias("last_ts"),
        F.max_by("latency", F.struct("ts", "seq")).alias("_lat"))
    now = as_of_latest(samples).scalar()          # scalar subquery
    age = seconds_between(now, F.col("last_ts"))
    fresh = age <= F.lit(stale_after)
    return (last
            .select("source", "last_ts", age.alias("age_seconds"), fresh.alias("is_fresh"),
                    F.when(fresh, F.col("_lat") * 1000).alias("latency_ms")))


def replication_lag(primary: DataFrame, replica: DataFrame, as_of: Column) -> DataFrame:
    """Lag of a replica from heartbeats (id, ts). The primary's latest heartbeat is the
    highest id, the replica's the latest ts. 0 when the replica has caught up, else
    (primary ts - replica ts) + (now - primary ts), never below 0."""
    p = primary.agg(F.max_by(F.struct("id", "ts"), "id").alias("p"))
    r = replica.agg(F.max_by(F.struct("id", "ts"), F.struct("ts", "id"))).scalar()   # scalar subquery
    lag = (seconds_between(F.col("p.ts"), r["ts"])
           + seconds_between(as_of, F.col("p.ts")))
    return (p.select("p", r.alias("r"))
            .select(F.col("p.id").alias("primary_id"), F.col("r.id").alias("replica_id"),
                    F.when(F.col("r.id") >= F.col("p.id"), F.lit(0.0))
                    .otherwise(F.greatest(F.lit(0.0), lag)).alias("lag_seconds")))


def refresh_age(log: DataFrame, as_of: Column) -> DataFrame:
    """Seconds since each view's last refresh."""
    return log.select("view_name", "last_refresh", "refresh_duration",
                      seconds_between(as_of, F.col("last_refresh")).alias("age_seconds"))


def reaction_time(priced: DataFrame, as_of: Column) -> DataFrame:
    """End-to-end reaction time now - last_update_time of each priced row."""
    return priced.select("product_id",
                         seconds_between(as_of, F.col("last_update_time")).alias("reaction_seconds"))


def memory_gb(percent: Column, total_gb: float = ASSUMED_MEMORY_GB) -> Column:
    """Memory percent -> GB of the assumed container size."""
    return percent / 100.0 * total_gb


def resource_stats(samples: DataFrame, n: int = KEEP_SAMPLES,
                   stale_after: float = RESOURCE_STALE_SECONDS) -> DataFrame:
    """CPU and memory of each container: the newest value and max, average and p99 over
    its last n samples, NULL when its newest sample is older than ``stale_after``; memory in GB
    too. ``samples``: (source=container, ts, seq, cpu, memory), both in percent."""
    parts = ("cpu", "memory")
    kept = last_samples(samples, n)
    agg = kept.groupBy("source").agg(
        F.count(F.lit(1)).alias("samples"), F.max("ts").alias("last_ts"),
        F.max_by(F.struct(*parts), F.struct("ts", "seq")).alias("_now"),
        *_statistics({c: F.col(c).cast("decimal(38,6)") for c in parts}))
    now = as_of_latest(samples).scalar()          # scalar subquery
    fresh = seconds_between(now, F.col("last_ts")) <= F.lit(stale_after)
    values = {f"{c}_usage": F.col(f"_now.{c}") for c in parts}
    for c in parts:
        values |= {f"{c}_{k}": statistics_struct(c)[k] for k in ("max", "average", "p99")}
    values |= {f"memory_{k}_gb": memory_gb(values[f"memory_{k}"]) for k in ("usage", "max")}
    return agg.select(F.col("source").alias("container"), "samples", fresh.alias("is_fresh"),
                      *[F.when(fresh, v).alias(k) for k, v in values.items()])


def pipeline_latency(latency_ms: Column) -> Column:
    """The answer pipeline's total: max(70, 20 + query ms) + 115; 185 without one."""
    return F.when(latency_ms.isNull(), F.lit(float(PIPELINE_DEFAULT_MS))).otherwise(
        F.greatest(F.lit(float(PIPELINE_FLOOR_MS)), F.lit(float(PIPELINE_BASE_MS)) + latency_ms)
        + F.lit(float(PIPELINE_TAIL_MS)))


def source_health(status_history: DataFrame, sources: DataFrame) -> DataFrame:
    """Restart is needed when any postgres source has a failed/stalled status."""
    # a hot source's history collapses to its id before anything is joined
    bad = status_history.where(F.col("status").isin("failed", "stalled")).select("source_id").distinct()
    hit = sources.where(F.col("type") == "postgres").join(bad, sources.id == bad.source_id, "left_semi")
    return hit.agg((F.count(F.lit(1)) > 0).alias("restart"))


def metrics_fields(samples: DataFrame, lag_seconds: Column, n: int = KEEP_SAMPLES,
                   stale_after: float = QUERY_STALE_SECONDS) -> DataFrame:
    """Every field of the metrics document, one row per source, NULL when the source is
    stale. ``samples``: source, ts, seq, latency, end_to_end, refresh_duration (seconds) and
    price (NULL: the sample brought none). ``lag_seconds``: the replica's lag (a scalar).

    Latency statistics follow `latency_stats`, the end-to-end and refresh ones the last n
    samples, all from one bounded top-n; the rate reads only the newest seconds, the only ones a
    fresh source's trailing second can lie in."""
    now = as_of_latest(samples).scalar()          # scalar subquery
    order = F.struct("ts", "seq")
    last = samples.groupBy("source").agg(
        F.max("ts").alias("last_ts"),
        F.max_by(F.struct("latency", "end_to_end", "refresh_duration"), order).alias("_last"),
        F.max_by("price", F.when(F.col("price").isNotNull(), order)).alias("_price"))
    kept = last_samples(samples, n).withColumn("_near", _in_last_second())
    stats = kept.groupBy("source").agg(*_statistics({
        "ms": F.when(F.col("_near"), ms_exact(F.col("latency"))),
        "e2e": ms_exact(F.col("end_to_end")),
        "refresh": F.col("refresh_duration").cast("decimal(38,6)")}))
    reach = stale_after + QPS_WINDOW_SECONDS
    recent = samples.where(F.col("ts") >= now - F.expr(f"INTERVAL {reach} SECONDS")).select("source", "ts")
    newest = recent.groupBy("source").agg(F.max("ts").alias("_newest"))
    rate = (recent.join(newest, "source")
            .where(seconds_between(F.col("_newest"), F.col("ts")) <= QPS_WINDOW_SECONDS)
            .groupBy("source").agg((F.count(F.lit(1)) / F.lit(QPS_WINDOW_SECONDS)).alias("_qps")))
    age = seconds_between(now, F.col("last_ts"))
    fresh = age <= F.lit(stale_after)
    fields = {"latency_ms": F.col("_last.latency") * 1000, "end_to_end_ms": F.col("_last.end_to_end") * 1000,
              "price": F.col("_price"), "qps": F.col("_qps"), "refresh_age": age,
              "refresh_duration": F.col("_last.refresh_duration"), "replica_lag": lag_seconds}
    for name, label in (("ms", "latency"), ("e2e", "end_to_end"), ("refresh", "refresh")):
        st = statistics_struct(name)
        fields |= {f"{label}_{part}": st[part] for part in ("max", "average", "p99")}
    return (last.join(stats, "source").join(rate, "source", "left")
            .select("source", fresh.alias("is_fresh"), *[F.when(fresh, v).alias(k) for k, v in fields.items()]))


def metrics_document(samples: DataFrame, lag_seconds: Column) -> DataFrame:
    """`metrics_fields` as one JSON object per source (NULL fields are left out)."""
    f = metrics_fields(samples, lag_seconds)
    return f.select("source", F.to_json(F.struct("*")).alias("body"))
