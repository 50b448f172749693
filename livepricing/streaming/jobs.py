"""Structured Streaming jobs: the maintained pricing/cart/category views, a replica kept
from a change stream, an exact event-rate aggregation and the batch-refreshed cache.

All of them read the events table as a file stream (``trigger(availableNow=True)`` drains
what is there, then stops; a long-running deployment uses a processing-time trigger on
the same code) and write through ``foreachBatch`` into a ``SnapshotStore``. The streaming
checkpoint and every snapshot live under the shared checkpoint folder, so a restarted
driver resumes, and a replayed batch rewrites only its own version.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cart as C
from ..operators import changes as CH
from ..operators.pricing import dynamic_pricing
from ..operators.ranking import top_k_per_group
from ..session import measured_broadcasts, stage_table
from ..sources.model import Model, read_table
from .changelog import Replay, to_changelog
from .incremental import event_changes
from .maintained import MaintainedViews
from .rate import TrailingRate
from .store import SnapshotStore


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The events table as a stream, be it one file or a folder of part files."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drain(stream: DataFrame, store: SnapshotStore, on_batch, name: str) -> None:
    q = (stream.writeStream.foreachBatch(on_batch)
         .option("checkpointLocation", f"{store.root}/stream-checkpoint/{name}")
         .trigger(availableNow=True).start())
    q.awaitTermination()


# --- T2-T4: maintained pricing, cart and category views --------------------------------------

def maintain_pricing(spark: SparkSession, sf_dir: str, m: Model, store: SnapshotStore | None = None,
                     max_files: int | None = None) -> MaintainedViews:
    """Bootstrap the state from the base tables (version 0), then fold every micro-batch of
    the events stream into a new committed version."""
    store = store or SnapshotStore(spark, name="pricing-stream")
    views = MaintainedViews(spark, m, store)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        if store.is_committed(version):        # replay of a finished batch
            return
        batch = batch.persist()
        try:
            views.apply(event_changes(batch, sf_dir), version, batch=batch_id)
        finally:
            batch.unpersist()

    with measured_broadcasts(spark):    # (the stream's own session starts as a copy of this one)
        if store.latest() is None:
            views.bootstrap()
        _drain(events_stream(spark, sf_dir, max_files), store, on_batch, "pricing")
    return views


# --- T1: all tables from one changelog ------------------------------------------------------

def replay_changelog(spark: SparkSession, sf_dir: str, m: Model, store: SnapshotStore | None = None) -> Replay:
    """The events as a changelog with one transaction per event, delivered in two pieces: the
    second half of the transactions lacks every third one at first, and is delivered again whole."""
    store = store or SnapshotStore(spark, name="changelog")
    views = MaintainedViews(spark, m, store)
    with measured_broadcasts(spark):
        views.bootstrap()
        ev = read_table(spark, sf_dir, "events")
        log = stage_table(to_changelog(event_changes(ev, sf_dir), ev.select(F.col("event_id").alias("txn"))), "changelog")
        lo, hi = ev.agg(F.min("event_id"), F.max("event_id")).first()
        replay = Replay(views, log.schema, lo)
        late = F.col("txn") >= (lo + hi) // 2
        replay.apply(log.where(~late | (F.col("txn") % 3 != 1)), 1)
        replay.apply(log.where(late), 2)
    return replay


def frontier_summary(replay: Replay) -> DataFrame:
    """Per version: its frontier and sums over the views of that version."""
    out = None
    for v in range(1, replay.views.store.latest() + 1):
        prices, lines, totals = (f(v) for f in (replay.views.prices, replay.views.cart_lines, replay.views.category_totals))
        micro = lambda c: F.coalesce(F.sum(F.round(F.col(c) * 1e6).cast("long")), F.lit(0))
        row = spark_row(prices.agg(F.count("*").alias("products"), micro("adjusted_price").alias("price_micros")),
                        lines.agg(F.count("*").alias("lines"), F.coalesce(F.sum("available_stock"), F.lit(0)).alias("line_stock"), micro("price").alias("line_micros")),
                        totals.agg(F.count("*").alias("categories"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("category_items")))
        row = row.select(F.lit(replay.frontier(v)).cast("long").alias("frontier"), *row.columns)
        out = row if out is None else out.unionByName(row)
    return out


def spark_row(*aggregates: DataFrame) -> DataFrame:
    """One row of several one-row aggregates, the later ones as scalar subqueries."""
    first, *rest = aggregates
    return first.select("*", *[a.select(c).scalar().alias(c) for a in rest for c in a.columns])


# --- T17: consistent multi-read -----------------------------------------------------------------

def pinned_cart_summary(views: MaintainedViews, version: int | None = None) -> DataFrame:
    """Items total and categories total read from one committed version, the newest by default."""
    v = views.store.latest() if version is None else version
    totals = views.category_totals(v)
    grand = (totals.where(F.col("parent_id").isNull())
             .agg(F.coalesce(F.sum(F.round(F.col("total") * 1e6).cast("bigint")), F.lit(0)).alias("_g"))
             .select((F.expr("div(_g + 5000, 10000)").cast("double") / 100.0)).scalar())
    return C.cart_total(views.cart_lines(v)).select(F.lit(v).alias("version"), "cart_total",
                                                    grand.alias("categories_total"))


# --- T1: replica from a change stream ------------------------------------------------------------

def change_records(ev: DataFrame) -> DataFrame:
    """events -> changes of a per-user table: an error deletes the user's row, anything
    else upserts it with the event's type and value."""
    return ev.select(F.col("user_id").alias("key"),
                     F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"),
                     F.col("event_id").alias("seq"), "event_type", "value")


def fold_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Per key the change of the largest seq, whatever order the batches come in (bounded
    before the shuffle). Deletes stay as tombstones (``deleted``), so an older upsert that
    arrives later does not bring the row back."""
    new = changes.withColumn("deleted", F.col("op") == "D").drop("op")
    return top_k_per_group(state.unionByName(new), ["key"], [F.col("seq").desc()], 1).drop("_rn")


def replica_rows(state: DataFrame) -> DataFrame:
    return state.where(~F.col("deleted")).drop("deleted")


def apply_changes(replica: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of a replica after one set of changes."""
    return replica_rows(fold_changes(replica.withColumn("deleted", F.lit(False)), changes))


def maintain_replica(spark: SparkSession, sf_dir: str, store: SnapshotStore | None = None,
                     max_files: int | None = None) -> SnapshotStore:
    store = store or SnapshotStore(spark, name="replica")
    if store.latest() is None:
        empty = spark.createDataFrame([], "key long, seq long, event_type string, value double, deleted boolean")
        store.write("replica_state", empty, 0)
        store.write("replica", replica_rows(empty), 0)
        store.commit(0, kind="empty")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        if store.is_committed(version):
            return
        store.write("replica_state", fold_changes(store.read("replica_state", version - 1), change_records(batch)),
                    version)
        store.write("replica", replica_rows(store.read("replica_state", version)), version)
        store.commit(version, batch=batch_id)

    _drain(events_stream(spark, sf_dir, max_files), store, on_batch, "replica")
    return store


# --- T10: rate over the stream --------------------------------------------------------------------

def maintain_rate(spark: SparkSession, sf_dir: str, window: str = "1 hour",
                  store: SnapshotStore | None = None, max_files: int | None = None) -> SnapshotStore:
    """Events per source and tumbling window. The partial counts of each batch are added to
    the stored ones, so late events count like all others: nothing is dropped by age."""
    store = store or SnapshotStore(spark, name="rate")
    if store.latest() is None:
        store.write("rate", spark.createDataFrame(
            [], "source string, window_start timestamp_ntz, events long"), 0)
        store.commit(0, kind="empty")
    ev = events_stream(spark, sf_dir, max_files).select(
        F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("event_time"))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        if store.is_committed(version):
            return
        counts = (batch.groupBy("source", F.window("event_time", window).alias("w"))
                  .agg(F.count(F.lit(1)).alias("events"))
                  .select("source", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "events"))
        merged = (store.read("rate", version - 1).unionByName(counts)
                  .groupBy("source", "window_start").agg(F.sum("events").alias("events")))
        store.write("rate", merged, version)
        store.commit(version, batch=batch_id)

    _drain(ev, store, on_batch, "rate")
    return store


def maintain_trailing_rate(spark: SparkSession, sf_dir: str, store: SnapshotStore | None = None,
                           max_files: int | None = None) -> TrailingRate:
    """At every sample of the stream the rate of its source in the trailing second."""
    store = store or SnapshotStore(spark, name="trailing-rate")
    rate = TrailingRate(spark, store)
    ev = events_stream(spark, sf_dir, max_files).select(F.col("event_type").alias("source"), "ts", F.col("event_id").alias("seq"))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if not store.is_committed(batch_id + 1):
            rate.apply(batch, batch_id + 1, batch=batch_id)

    _drain(ev, store, on_batch, "trailing-rate")
    return rate


# --- T5: batch-refreshed cache with a refresh log --------------------------------------------

def refresh_cached_pricing(spark: SparkSession, m: Model, store: SnapshotStore | None = None,
                           view_name: str = "mv_dynamic_pricing") -> SnapshotStore:
    """Full recompute into a new snapshot version, then upsert the refresh-log row (name,
    refresh time, duration) and commit both together."""
    store = store or SnapshotStore(spark, name="cached-pricing")
    prev = store.latest()
    version = 0 if prev is None else prev + 1
    started = time.time()
    store.write("prices", dynamic_pricing(m), version)
    duration = time.time() - started
    row = spark.createDataFrame([(view_name, duration)], "view_name string, refresh_duration double") \
        .select("view_name", F.current_timestamp().alias("last_refresh"), "refresh_duration")
    log = row if prev is None else CH.upsert(store.read("refresh_log", prev), row, "view_name")
    store.write("refresh_log", log, version)
    store.commit(version, kind="refresh")
    return store
