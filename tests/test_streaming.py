"""Streaming jobs: restart without duplicates, commit visibility, rate vs batch."""

import datetime as dt
import re
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from conftest import SF_SMALL
from livepricing.sources.model import from_driver_tables, read_table
from livepricing.streaming import jobs as J
from livepricing.streaming.store import SnapshotStore


def test_replica_restart_is_idempotent(spark):
    store = SnapshotStore(spark, tempfile.mkdtemp(prefix="lp-replica-"))
    J.maintain_replica(spark, SF_SMALL, store=store)
    v1 = store.latest()
    first = sorted(tuple(r) for r in store.read("replica").collect())
    J.maintain_replica(spark, SF_SMALL, store=store)     # restart: nothing new to read
    assert store.latest() == v1
    assert sorted(tuple(r) for r in store.read("replica").collect()) == first
    ev = read_table(spark, SF_SMALL, "events")
    users_alive = (ev.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"))
                   .where(F.col("t") != "error").count())
    assert len(first) == users_alive


def test_uncommitted_version_is_invisible(spark):
    store = SnapshotStore(spark, tempfile.mkdtemp(prefix="lp-store-"))
    store.write("t", spark.createDataFrame([(1,)], "x int"), 0)
    store.commit(0)
    store.write("t", spark.createDataFrame([(2,)], "x int"), 1)    # crashed before commit
    assert store.latest() == 0
    assert [r.x for r in store.read("t").collect()] == [1]
    assert not store.is_committed(1)


def test_rate_stream_equals_batch_count(spark):
    store = J.maintain_rate(spark, SF_SMALL, store=SnapshotStore(spark, tempfile.mkdtemp(prefix="lp-rate-")))
    got = sorted((r.source, r.window_start, r.events) for r in store.read("rate").collect())
    ev = read_table(spark, SF_SMALL, "events")
    want = sorted((r.event_type, r.w, r.n) for r in ev.groupBy(
        "event_type", F.date_trunc("hour", "ts").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect())
    assert got == want


def _as_folder(spark, tmp_path, newest_first):
    """The events in four part files of a folder, by event id, so that old rows come last."""
    import os
    import time
    out = tmp_path / "events.parquet"
    ev = read_table(spark, SF_SMALL, "events")
    order = F.col("event_id").desc() if newest_first else F.col("event_id")
    ev.repartitionByRange(4, order).write.parquet(str(out))
    now = time.time()
    for n, f in enumerate(sorted(p for p in os.listdir(out) if p.endswith(".parquet"))):
        os.utime(out / f, (now - 1000 + n, now - 1000 + n))
    return str(tmp_path)


def test_folder_table_newest_first_equals_batch(spark, tmp_path):
    sf = _as_folder(spark, tmp_path, newest_first=True)
    rate = J.maintain_rate(spark, sf, store=SnapshotStore(spark, tempfile.mkdtemp(prefix="lp-rate-")), max_files=2)
    ev = read_table(spark, SF_SMALL, "events")
    assert rate.latest() >= 2
    assert rate.read("rate").agg(F.sum("events")).first()[0] == ev.count()
    replica = J.maintain_replica(spark, sf, store=SnapshotStore(spark, tempfile.mkdtemp(prefix="lp-replica-")), max_files=2)
    last = ev.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"), F.max("event_id").alias("e")).where("t <> 'error'")
    assert sorted((r.key, r.seq) for r in replica.read("replica").collect()) == sorted((r.user_id, r.e) for r in last.collect())


def test_trailing_rate_newest_first_equals_batch(spark, tmp_path):
    """Later batches only bring older samples, which change the rates of stored ones."""
    from livepricing.operators.metrics import trailing_qps
    from livepricing.streaming.rate import TrailingRate
    rows = [(f"s{i % 3}", 250 * ((i * 37) % 90), i) for i in range(120)]
    sample = spark.createDataFrame(rows, "source string, ms long, seq long").selectExpr(
        "source", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, ms / 1000.0) AS ts", "seq")
    rate = TrailingRate(spark, SnapshotStore(spark, str(tmp_path / "rate")), compact_every=2)
    half = F.col("ts") >= F.lit("2024-01-01 00:00:11").cast("timestamp_ntz")
    third = F.col("seq") % 3 == 0
    for v, part in enumerate([half & third, half, ~half], 1):     # the second brings samples again
        rate.apply(sample.where(part), v)
    want = sorted((r.source, r.ts, r.seq, r.queries) for r in trailing_qps(sample).collect())
    assert sorted((r.source, r.ts, r.seq, r.queries) for r in rate.read().collect()) == want
    assert rate.store.base_of(3) == 2


def _small_tables(spark, tmp_path):
    """A folder with a few rows in each of the driver's tables."""
    t = dt.datetime(2024, 1, 1)
    tables = {
        "region": ([(0, "EAST")], "r_regionkey int, r_name string"),
        "nation": ([(n, f"N{n}", 0) for n in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(s, f"S{s}", s % 25) for s in range(4)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(p, f"{'small' if p % 3 == 0 else 'large'} p{p}", 900.0 + p) for p in range(20)], "p_partkey long, p_name string, p_retailprice double"),
        "lineitem": ([(i // 3, i % 20, i % 4, i % 3, float(1 + i % 9), 100.0 + i, 0.05 * (i % 3), "NR"[i % 2], "OF"[i % 2], t + dt.timedelta(days=i)) for i in range(60)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "events": ([(i, t + dt.timedelta(minutes=7 * i), ("purchase", "view", "error", "click", "signup")[i % 5 if i % 4 else 1], 1.0 + i, f'{{"k": {i % 15}}}') for i in range(40)],
                   "event_id long, ts timestamp_ntz, event_type string, value double, props string"),
    }
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.fixture
def broadcast_joins(spark, monkeypatch):
    """The broadcast joins of all written plans, as planned before anything is measured."""
    found, write = [], DataFrameWriter.parquet

    def planned(self, *args, **options):
        found.extend(_broadcasts(self._df))
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", planned)
    return found


def _broadcasts(df):
    return re.findall(r"Broadcast(?:Hash|NestedLoop)Join.*", df._jdf.queryExecution().executedPlan().toString())


def test_maintained_views_broadcast_no_side_for_its_small_files(spark, tmp_path, broadcast_joins):
    """The size of compressed files says little about rows in the driver's memory."""
    folder = _small_tables(spark, tmp_path)
    m = from_driver_tables(spark, folder)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    was = [spark.conf.get(k, None) for k in keys]
    views = J.maintain_pricing(spark, folder, m, store=SnapshotStore(spark, tempfile.mkdtemp(prefix="lp-views-")))
    assert [spark.conf.get(k, None) for k in keys] == was
    assert views.store.latest() == 1 and views.prices().count() > 0
    # only the ten largest stocks, whose number is bounded
    assert [j for j in broadcast_joins if "total_stock" not in j] == []
    assert _broadcasts(J.pinned_cart_summary(views)) == _broadcasts(views.category_totals()) == []
    assert J.pinned_cart_summary(views).first()["cart_total"] > 0


def test_replay_broadcasts_no_side_for_its_small_files(spark, tmp_path, broadcast_joins):
    folder = _small_tables(spark, tmp_path)
    replay = J.replay_changelog(spark, folder, from_driver_tables(spark, folder), store=SnapshotStore(spark, tempfile.mkdtemp(prefix="lp-replay-")))
    assert [j for j in broadcast_joins if "total_stock" not in j] == []
    summary = J.frontier_summary(replay)
    assert _broadcasts(summary) == []
    assert sorted(r.frontier for r in summary.collect()) == [18, 39]
