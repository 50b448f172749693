"""Registered metric queries: the events table is the sample stream
(source = event type, latency = value in seconds, seq = event id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.pricing import dynamic_pricing
from ..sources.model import driver_samples, read_table
from .oracle import pricing_sql
from .registry import model_for, register

SAMPLES_SQL = "SELECT event_type AS source, ts, value AS latency, event_id AS seq, user_id FROM events"


def _stat_sql(of: str, label: str) -> str:
    return f"""CAST(max({of}) AS DOUBLE) AS {label}_max, CAST(sum({of}) AS DOUBLE) / count({of}) AS {label}_average,
    CAST(CASE WHEN count({of}) >= 100 THEN list_sort(list({of}) FILTER ({of} IS NOT NULL))[CAST(floor(count({of}) * 0.99) AS INTEGER) + 1]
         ELSE max({of}) END AS DOUBLE) AS {label}_p99"""


def samples(spark, sf_dir):
    return driver_samples(spark, sf_dir)


@register("latency_stats", f"""
WITH s AS ({SAMPLES_SQL}),
top AS (SELECT source, max(ts) AS t FROM s GROUP BY source),
k AS (SELECT s.source, CAST(latency * 1000 AS DECIMAL(38,6)) AS ms,
             row_number() OVER (PARTITION BY s.source ORDER BY ts DESC, seq DESC) AS rn
      FROM s JOIN top ON top.source = s.source AND s.ts >= top.t - INTERVAL 1 SECOND)
SELECT source, COUNT(ms) AS samples, CAST(MAX(ms) AS DOUBLE) AS max_ms,
       CAST(SUM(ms) AS DOUBLE) / COUNT(ms) AS avg_ms,
       CAST(CASE WHEN COUNT(ms) >= 100
                 THEN list_sort(list(ms))[CAST(floor(COUNT(ms) * 0.99) AS INTEGER) + 1]
                 ELSE MAX(ms) END AS DOUBLE) AS p99_ms
FROM k WHERE rn <= 100 GROUP BY source""", ids="A13 S13 S14 S19")
def latency_stats(spark, sf_dir):
    return M.latency_stats(samples(spark, sf_dir))


@register("last_100_stats", f"""
WITH s AS ({SAMPLES_SQL}),
k AS (SELECT source, CAST(latency * 1000 AS DECIMAL(38,6)) AS ms,
             row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) AS rn FROM s)
SELECT source, COUNT(ms) AS samples, CAST(MAX(ms) AS DOUBLE) AS max_ms,
       CAST(SUM(ms) AS DOUBLE) / COUNT(ms) AS avg_ms,
       CAST(CASE WHEN COUNT(ms) >= 100
                 THEN list_sort(list(ms))[CAST(floor(COUNT(ms) * 0.99) AS INTEGER) + 1]
                 ELSE MAX(ms) END AS DOUBLE) AS p99_ms
FROM k WHERE rn <= 100 GROUP BY source""", ids="A13 W5 S13 S14")
def last_100_stats(spark, sf_dir):
    return M.last_n_stats(samples(spark, sf_dir))


@register("rolling_100", f"""
WITH s AS ({SAMPLES_SQL}),
f AS (SELECT source, ts, seq, list(CAST(latency * 1000 AS DECIMAL(38,6))) OVER (
        PARTITION BY source ORDER BY ts, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS v FROM s)
SELECT source, ts, seq, CAST(len(list_filter(v, lambda x: x IS NOT NULL)) AS BIGINT) AS samples,
       CAST(list_max(v) AS DOUBLE) AS max_ms,
       CAST(list_sum(v) AS DOUBLE) / len(list_filter(v, lambda x: x IS NOT NULL)) AS avg_ms,
       CAST(CASE WHEN len(v) >= 100 THEN list_sort(v)[CAST(floor(len(v) * 0.99) AS INTEGER) + 1]
                 ELSE list_max(v) END AS DOUBLE) AS p99_ms FROM f""", ids="W5")
def rolling_100(spark, sf_dir):
    return M.rolling_stats(samples(spark, sf_dir))


TRAILING_SQL = f"""
WITH s AS ({SAMPLES_SQL}),
c AS (SELECT source, ts, seq,
             count(*) OVER (PARTITION BY source ORDER BY ts
                            RANGE BETWEEN INTERVAL 1 SECOND PRECEDING AND CURRENT ROW)
             - count(*) OVER (PARTITION BY source, ts)
             + row_number() OVER (PARTITION BY source, ts ORDER BY seq) AS queries FROM s)
SELECT source, ts, seq, queries, queries / CAST(1.0 AS DOUBLE) AS qps FROM c"""


@register("qps_1s", TRAILING_SQL, ids="W6 T10")
def qps_1s(spark, sf_dir):
    return M.trailing_qps(samples(spark, sf_dir))


@register("qps_per_second", f"""
WITH s AS ({SAMPLES_SQL})
SELECT source, time_bucket(INTERVAL 1 second, ts) AS window_start, COUNT(*) AS queries,
       COUNT(*) / GREATEST(CAST(1.0 AS DOUBLE), (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS qps
FROM s GROUP BY 1, 2""", ids="T10")
def qps_per_second(spark, sf_dir):
    return M.qps(samples(spark, sf_dir))


@register("history_window", f"""
WITH s AS ({SAMPLES_SQL}),
n AS (SELECT source, max(ts) AS newest FROM s GROUP BY source),
r AS (SELECT s.source, s.ts, s.latency,
             row_number() OVER (PARTITION BY s.source ORDER BY s.ts DESC, s.seq DESC) AS point
      FROM s JOIN n USING (source) WHERE s.ts >= n.newest - INTERVAL 180 SECONDS)
SELECT source, ts, latency, point FROM r WHERE point <= 180""", ids="W7 F5")
def history_window(spark, sf_dir):
    return M.history_window(samples(spark, sf_dir)).withColumn("point", F.col("point").cast("bigint"))


SERIES_SQL = f"""WITH s AS ({SAMPLES_SQL}),
series AS (SELECT user_id, ts, seq, CASE WHEN source <> 'error' THEN latency END AS price FROM s),
filled AS (SELECT *, last_value(price IGNORE NULLS) OVER (
             PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             AS price_filled FROM series)"""


@register("carry_forward", SERIES_SQL + "\nSELECT user_id, ts, seq, price, price_filled FROM filled",
          ids="W8")
def carry_forward(spark, sf_dir):
    return M.carry_forward(M.price_series(samples(spark, sf_dir)))


@register("price_changes", SERIES_SQL + """
, c AS (SELECT *, lag(price_filled) OVER (PARTITION BY user_id ORDER BY ts, seq) AS prev_price FROM filled)
SELECT user_id, ts, seq, price_filled, prev_price,
       NOT (price_filled IS NOT DISTINCT FROM prev_price) AS changed FROM c""", ids="W9")
def price_changes(spark, sf_dir):
    return M.price_changes(M.price_series(samples(spark, sf_dir)))


@register("source_gaps", f"""
WITH s AS ({SAMPLES_SQL}),
g AS (SELECT source, ts, seq,
             (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source ORDER BY ts, seq))) / 1e6
               AS gap_seconds FROM s)
SELECT source, ts, seq, gap_seconds,
       CASE WHEN gap_seconds IS NULL THEN 'Unknown' WHEN gap_seconds < 1.0 THEN 'Low'
            WHEN gap_seconds < 5.0 THEN 'Medium' ELSE 'High' END AS band
FROM g""", ids="P14 W9")
def source_gaps(spark, sf_dir):
    return M.source_gaps(samples(spark, sf_dir))


@register("freshness_gate", f"""
WITH s AS ({SAMPLES_SQL}),
l AS (SELECT source, max(ts) AS last_ts, arg_max(latency, (ts, seq)) AS lat FROM s GROUP BY source),
n AS (SELECT max(ts) AS as_of FROM s)
SELECT source, last_ts, (epoch_us(as_of) - epoch_us(last_ts)) / 1e6 AS age_seconds,
       (epoch_us(as_of) - epoch_us(last_ts)) / 1e6 <= 2.0 AS is_fresh,
       CASE WHEN (epoch_us(as_of) - epoch_us(last_ts)) / 1e6 <= 2.0 THEN lat * 1000 END AS latency_ms
FROM l, n""", ids="T9 F5 F6")
def freshness_gate(spark, sf_dir):
    return M.freshness_gate(samples(spark, sf_dir))


HEARTBEATS_SQL = """WITH hb AS (SELECT event_id AS id, ts FROM events WHERE event_type = 'view'),
n AS (SELECT max(ts) AS as_of FROM events),
rep AS (SELECT hb.* FROM hb, n WHERE hb.ts < n.as_of - INTERVAL 6 HOURS)"""


def heartbeats(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    primary = ev.where(F.col("event_type") == "view").select(F.col("event_id").alias("id"), "ts")
    as_of = ev.agg(F.max("ts")).scalar()                   # scalar subquery
    replica = primary.where(F.col("ts") < as_of - F.expr("INTERVAL 6 HOURS"))
    return primary, replica, as_of


@register("replication_lag", HEARTBEATS_SQL + """
, p AS (SELECT arg_max(id, id) AS pid, arg_max(ts, id) AS pts FROM hb),
r AS (SELECT arg_max(id, (ts, id)) AS rid, max(ts) AS rts FROM rep)
SELECT pid AS primary_id, rid AS replica_id,
       CASE WHEN rid >= pid THEN CAST(0.0 AS DOUBLE)
            ELSE GREATEST(CAST(0.0 AS DOUBLE), (epoch_us(pts) - epoch_us(rts)) / 1e6
                                              + (epoch_us(as_of) - epoch_us(pts)) / 1e6) END AS lag_seconds
FROM p, r, n""", ids="T7 J14 O3 S21")
def replication_lag(spark, sf_dir):
    primary, replica, now = heartbeats(spark, sf_dir)
    return M.replication_lag(primary, replica, now)


REFRESH_LOG_SQL = """WITH log AS (
  SELECT 'mv_' || event_type AS view_name, max(ts) AS last_refresh,
         arg_max(value, (ts, event_id)) / 1000.0 AS refresh_duration FROM events GROUP BY event_type),
n AS (SELECT max(ts) AS as_of FROM events)"""


def refresh_log(spark, sf_dir):
    """A refresh log derived from events: each event type is a view, its newest event the
    last refresh (an IO7 upsert target)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.groupBy("event_type").agg(
        F.max("ts").alias("last_refresh"),
        (F.max_by("value", F.struct("ts", "event_id")) / 1000.0).alias("refresh_duration")).select(
        F.concat(F.lit("mv_"), "event_type").alias("view_name"), "last_refresh", "refresh_duration")


@register("refresh_age", REFRESH_LOG_SQL + """
SELECT view_name, last_refresh, refresh_duration,
       (epoch_us(as_of) - epoch_us(last_refresh)) / 1e6 AS age_seconds FROM log, n""", ids="T6")
def refresh_age(spark, sf_dir):
    now = read_table(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    return M.refresh_age(refresh_log(spark, sf_dir), now)


@register("reaction_time", pricing_sql("""
, n AS (SELECT max(ts) AS as_of FROM events)
SELECT product_id, (epoch_us(as_of) - epoch_us(last_update_time)) / 1e6 AS reaction_seconds
FROM live_price, n"""), ids="T8")
def reaction_time(spark, sf_dir):
    m = model_for(spark, sf_dir)
    now = read_table(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    return M.reaction_time(dynamic_pricing(m), now)


RESOURCE_SQL = """SELECT event_type AS source, ts, event_id AS seq, LEAST(value, 100.0) AS cpu,
       LEAST(value / 2, 100.0) AS memory FROM events"""
RESOURCE_FIELDS = [f"{c}_{k}" for c in ("cpu", "memory") for k in ("usage", "max", "average", "p99")]


@register("resource_stats", f"""
WITH s AS ({RESOURCE_SQL}),
k AS (SELECT *, CAST(cpu AS DECIMAL(38,6)) AS c, CAST(memory AS DECIMAL(38,6)) AS m,
             row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) AS rn FROM s),
a AS (SELECT source, COUNT(*) AS samples, {_stat_sql('c', 'cpu')}, {_stat_sql('m', 'memory')}
      FROM k WHERE rn <= 100 GROUP BY source),
u AS (SELECT source, cpu AS cpu_usage, memory AS memory_usage,
             (epoch_us((SELECT max(ts) FROM s)) - epoch_us(ts)) / 1e6 <= 10.0 AS fresh FROM k WHERE rn = 1)
SELECT source AS container, samples, fresh AS is_fresh,
       {', '.join(f"CASE WHEN fresh THEN {c} END AS {c}" for c in RESOURCE_FIELDS)},
       CASE WHEN fresh THEN memory_usage / 100.0 * 4.0 END AS memory_usage_gb,
       CASE WHEN fresh THEN memory_max / 100.0 * 4.0 END AS memory_max_gb
FROM a JOIN u USING (source)""", ids="V13 P15 A13 T9")
def resource_stats(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    s = ev.select(F.col("event_type").alias("source"), "ts", F.col("event_id").alias("seq"),
                  F.least(F.col("value"), F.lit(100.0)).alias("cpu"),
                  F.least(F.col("value") / 2, F.lit(100.0)).alias("memory"))
    return M.resource_stats(s)


@register("pipeline_latency", f"""
WITH s AS ({SAMPLES_SQL})
SELECT source, seq, CASE WHEN source = 'error' THEN CAST(185.0 AS DOUBLE)
                         ELSE GREATEST(CAST(70.0 AS DOUBLE), 20.0 + latency) + 115.0 END AS total_ms
FROM s""", ids="P16")
def pipeline_latency(spark, sf_dir):
    s = samples(spark, sf_dir)
    ms = F.when(F.col("source") != "error", F.col("latency"))
    return s.select("source", "seq", M.pipeline_latency(ms).alias("total_ms"))


STATUS_SQL = """WITH st AS (SELECT user_id % 10 AS source_id,
   CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'starting' ELSE 'running' END AS status
   FROM events),
src AS (SELECT DISTINCT user_id % 10 AS id,
        CASE WHEN user_id % 2 = 0 THEN 'postgres' ELSE 'webhook' END AS type FROM events)"""


def status_tables(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    status = ev.select((F.col("user_id") % 10).alias("source_id"),
                       F.when(F.col("event_type") == "error", "failed")
                       .when(F.col("event_type") == "signup", "starting")
                       .otherwise("running").alias("status"))
    sources = ev.select((F.col("user_id") % 10).alias("id"),
                        F.when(F.col("user_id") % 2 == 0, "postgres").otherwise("webhook")
                        .alias("type")).distinct()
    return status, sources


@register("source_health", STATUS_SQL + """
SELECT count(*) > 0 AS restart FROM st JOIN src ON src.id = st.source_id
WHERE src.type = 'postgres' AND st.status IN ('failed', 'stalled')""", ids="V14 J13")
def source_health(spark, sf_dir):
    status, sources = status_tables(spark, sf_dir)
    return M.source_health(status, sources)


def query_samples(spark, sf_dir):
    """Samples with what the metrics document needs beside the latency: the view counts as
    refreshed at every whole minute (the end-to-end latency is the time since then), a refresh
    takes value / 1000 seconds, and error samples bring no price."""
    ev = read_table(spark, sf_dir, "events")
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    return ev.select(F.col("event_type").alias("source"), "ts", F.col("event_id").alias("seq"),
                     F.col("value").alias("latency"), M.seconds_between(F.col("ts"), minute).alias("end_to_end"),
                     (F.col("value") / 1000.0).alias("refresh_duration"),
                     F.when(F.col("event_type") != "error", F.col("value")).alias("price"))


METRICS_SQL = f"""WITH s AS (SELECT event_type AS source, ts, event_id AS seq, value AS latency,
    (epoch_us(ts) - epoch_us(date_trunc('minute', ts))) / 1e6 AS e2e, value / 1000.0 AS took FROM events),
clock AS (SELECT max(ts) AS t FROM s),
hb AS (SELECT event_id AS id, ts FROM events WHERE event_type = 'view'),
ahead AS (SELECT id, ts FROM hb ORDER BY id DESC LIMIT 1),
behind AS (SELECT hb.id, hb.ts FROM hb, clock WHERE hb.ts < t - INTERVAL 6 HOURS ORDER BY hb.ts DESC, hb.id DESC LIMIT 1),
lag AS (SELECT CASE WHEN b.id >= a.id THEN CAST(0.0 AS DOUBLE)
    ELSE GREATEST(CAST(0.0 AS DOUBLE), (epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 + (epoch_us(t) - epoch_us(a.ts)) / 1e6) END AS secs
    FROM ahead a, behind b, clock),
n AS (SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY ts DESC, seq DESC) AS age_rank,
             max(ts) OVER (PARTITION BY source) AS newest FROM s),
pieces AS (SELECT *, CASE WHEN ts >= newest - INTERVAL 1 SECOND THEN CAST(latency * 1000 AS DECIMAL(38,6)) END AS a,
    CAST(e2e * 1000 AS DECIMAL(38,6)) AS b, CAST(took AS DECIMAL(38,6)) AS c FROM n WHERE age_rank <= 100),
st AS (SELECT source, {_stat_sql('a', 'latency')}, {_stat_sql('b', 'end_to_end')}, {_stat_sql('c', 'refresh')}
       FROM pieces GROUP BY source),
rate AS (SELECT source, count(*) / CAST(1.0 AS DOUBLE) AS qps FROM n WHERE ts >= newest - INTERVAL 1 SECOND GROUP BY source),
cur AS (SELECT source, newest, latency * 1000 AS latency_ms, e2e * 1000 AS end_to_end_ms, took AS refresh_duration,
               CASE WHEN source <> 'error' THEN latency END AS price FROM n WHERE age_rank = 1),
wide AS (SELECT cur.source, (epoch_us(t) - epoch_us(newest)) / 1e6 AS refresh_age, latency_ms, end_to_end_ms, price, qps,
               refresh_duration, secs AS replica_lag, st.* EXCLUDE (source)
        FROM cur JOIN st USING (source) JOIN rate USING (source), clock, lag)"""
METRIC_FIELDS = ["latency_ms", "end_to_end_ms", "price", "qps", "refresh_age", "refresh_duration", "replica_lag",
                 *[f"{a}_{b}" for a in ("latency", "end_to_end", "refresh") for b in ("max", "average", "p99")]]


def _metrics(spark, sf_dir):
    lag = M.replication_lag(*heartbeats(spark, sf_dir)).select("lag_seconds").scalar()
    return query_samples(spark, sf_dir), lag


FIELDS_SQL = (METRICS_SQL + "\nSELECT source, refresh_age <= 2.0 AS is_fresh, "
          + ", ".join(f"CASE WHEN refresh_age <= 2.0 THEN {c} END AS {c}" for c in METRIC_FIELDS) + " FROM wide")


@register("metrics_fields", FIELDS_SQL, ids="V10 T6 T7 T9")
def metrics_fields(spark, sf_dir):
    return M.metrics_fields(*_metrics(spark, sf_dir))


@register("metrics_document", FIELDS_SQL, ids="V10")
def metrics_document(spark, sf_dir):
    """The fields, read back from the objects' JSON text."""
    read = _metrics(spark, sf_dir)
    fields = M.metrics_fields(*read).schema
    return M.metrics_document(*read).select(F.from_json("body", fields).alias("o")).select("o.*")
