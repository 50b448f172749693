"""Boundary fixtures: ties at ranks 3 and 10, the 100-sample cap, refresh modes agree."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import make_model
from livepricing.operators import metrics as M
from livepricing.operators import pricing as P
from livepricing.sources.model import from_driver_tables
from livepricing.streaming.jobs import refresh_cached_pricing
from conftest import SF_SMALL


def test_ties_at_rank_three_and_ten_share_the_band(spark):
    # counts: 12, 11, 9, 9, 8, 7, 6, 5, 4, 3, 3, 1 -> ranks 1,2,3,3,5,6,7,8,9,10,10,12
    counts = [12, 11, 9, 9, 8, 7, 6, 5, 4, 3, 3, 1]
    products = [(i + 1, f"p{i + 1}", 1000, 7) for i in range(len(counts))]
    sales, sid = [], 0
    for pid, n in enumerate(counts, start=1):
        for _ in range(n):
            sid += 1
            sales.append((sid, pid, 1000, sid))
    m = make_model(spark, products, sales)
    f = {r.product_id: r for r in P.pricing_factors(m).collect()}
    assert [f[p].popularity_rank for p in range(1, 13)] == [1, 2, 3, 3, 5, 6, 7, 8, 9, 10, 10, None]
    assert f[4].popularity_adjustment == 1.2 and f[5].popularity_adjustment == 1.1
    assert f[11].popularity_adjustment == 1.1 and f[12].popularity_adjustment == 0.9
    full = {r.product_id: r.popularity_rank for r in P.popularity_rank(m).collect()}
    assert full[12] == 12


@pytest.mark.parametrize("n", [1, 99, 100, 101])
def test_last_n_stats_cap_and_p99(spark, n):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("q", t0 + dt.timedelta(seconds=i), float(i + 1) / 1000, i) for i in range(n)]
    s = spark.createDataFrame(rows, "source string, ts timestamp_ntz, latency double, seq long")
    r = M.last_n_stats(s).first()
    kept = list(range(max(0, n - 100) + 1, n + 1))          # last 100 values in ms
    assert r.samples == len(kept)
    assert r.max_ms == pytest.approx(max(kept))
    assert r.avg_ms == pytest.approx(sum(kept) / len(kept))
    assert r.p99_ms == pytest.approx(max(kept))             # with the cap, p99 is the max


def test_cached_refresh_equals_on_demand_and_logs(spark):
    m = from_driver_tables(spark, SF_SMALL)
    store = refresh_cached_pricing(spark, m)
    store = refresh_cached_pricing(spark, m, store=store)      # second refresh, new version
    assert store.latest() == 1
    cached = sorted(tuple(r) for r in store.read("prices").collect())
    live = sorted(tuple(r) for r in P.dynamic_pricing(m).collect())
    assert cached == live
    log = store.read("refresh_log").collect()
    assert len(log) == 1 and log[0].view_name == "mv_dynamic_pricing" and log[0].refresh_duration >= 0
    ages = M.refresh_age(store.read("refresh_log"), F.current_timestamp()).first()
    assert ages.age_seconds >= 0


def test_cluster_sizing():
    from livepricing.session import cluster_conf
    conf = cluster_conf(100 * 1024 ** 4, cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    small = cluster_conf(10 * 1024 ** 2, cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
