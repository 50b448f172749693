"""Trailing rate, rolling and evicted statistics against walks over the sorted samples. One hot
source holds a third of the rows within a few minutes; times tie."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from livepricing.operators import metrics as M

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = [("hot", T0 + dt.timedelta(milliseconds=250 * rnd.randrange(1200)), rnd.randrange(1, 900) / 1000) for _ in range(700)]
    out += [(f"s{i % 7}", T0 + dt.timedelta(milliseconds=500 * rnd.randrange(600)), rnd.randrange(1, 900) / 1000) for i in range(1300)]
    out += [("old", T0 - dt.timedelta(days=2), 0.5)]
    return [(s, t, v, i) for i, (s, t, v) in enumerate(out)]


@pytest.fixture(scope="module")
def samples(spark, rows):
    return spark.createDataFrame(rows, "source string, ts timestamp_ntz, latency double, seq long").repartition(7)


def series(rows):
    out = {}
    for s, t, v, i in sorted(rows, key=lambda r: (r[1], r[3])):
        out.setdefault(s, []).append((t, i, v))
    return out


def stats(values):
    v = sorted(values)
    return (len(v), v[-1], sum(v) / len(v), v[int(len(v) * 0.99)] if len(v) >= 100 else v[-1])


def test_trailing_qps(samples, rows):
    want = {}
    for walk in series(rows).values():
        for n, (t, i, _) in enumerate(walk):
            want[i] = sum(t - u <= dt.timedelta(seconds=1) for u, _, _ in walk[: n + 1])
    got = M.trailing_qps(samples).collect()
    assert len(got) == len(rows) and {r.seq: r.queries for r in got} == want
    assert all(r.qps == r.queries for r in got)


@pytest.mark.parametrize("block", [100, 333, 100_000])
def test_rolling_stats(samples, rows, block):
    want = {}
    for walk in series(rows).values():
        for n, (_, i, _) in enumerate(walk):
            want[i] = stats([v * 1000 for _, _, v in walk[max(0, n - 99): n + 1]])
    got = {r.seq: (r.samples, r.max_ms, r.avg_ms, r.p99_ms) for r in M.rolling_stats(samples, block=block).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_evicted_statistics_and_document(spark, samples, rows):
    walks = series(rows)
    now = max(t for _, t, _, _ in rows)
    near = {s: [v * 1000 for t, _, v in w[-100:] if w[-1][0] - t <= dt.timedelta(seconds=1)] for s, w in walks.items()}
    got = {r.source: (r.samples, r.max_ms, r.avg_ms, r.p99_ms) for r in M.latency_stats(samples).collect()}
    assert got.keys() == near.keys() and all(got[s] == pytest.approx(stats(near[s])) for s in near)
    full = (samples.withColumn("end_to_end", F.col("latency") * 2).withColumn("refresh_duration", F.col("latency") * 3)
            .withColumn("price", F.when(F.col("seq") % 2 == 0, F.col("latency"))))
    doc = {r.source: r for r in M.metrics_fields(full, F.lit(1.5)).collect()}
    assert doc.keys() == walks.keys() and not doc["old"].is_fresh and doc["old"].qps is None
    for s, w in walks.items():
        if (now - w[-1][0]).total_seconds() > 2:
            assert not doc[s].is_fresh
            continue
        d, last = doc[s], [v for _, _, v in w[-100:]]
        assert d.is_fresh and d.qps == sum(w[-1][0] - t <= dt.timedelta(seconds=1) for t, _, _ in w)
        assert (d.latency_max, d.latency_average, d.latency_p99) == pytest.approx(stats(near[s])[1:])
        assert (d.end_to_end_max, d.end_to_end_average) == pytest.approx(stats([2000 * v for v in last])[1:3])
        assert (d.refresh_max, d.refresh_p99) == pytest.approx((max(3 * v for v in last),) * 2)
        assert d.price == [v for _, i, v in w if i % 2 == 0][-1] and d.replica_lag == 1.5


def test_resource_statistics(samples, rows):
    walks = series(rows)
    now = max(t for _, t, _, _ in rows)
    got = {r.container: r for r in M.resource_stats(samples.withColumnRenamed("latency", "cpu")
                                                    .withColumn("memory", F.col("cpu") * 50)).collect()}
    assert got.keys() == walks.keys()
    for s, w in walks.items():
        r, last = got[s], [v for _, _, v in w[-100:]]
        if (now - w[-1][0]).total_seconds() > 10:
            assert not r.is_fresh and r.cpu_usage is None and r.memory_max_gb is None
            continue
        assert (r.samples, r.cpu_max, r.cpu_average, r.cpu_p99) == pytest.approx(stats(last))
        assert r.cpu_usage == last[-1] and r.memory_usage == pytest.approx(50 * last[-1])
        assert r.memory_max_gb == pytest.approx(50 * max(last) / 100 * 4)


def test_health_needs_a_failed_postgres_source(spark):
    sources = spark.createDataFrame([(1, "postgres"), (2, "webhook")], "id long, type string")
    for history, want in (([(1, "running"), (2, "failed")], False), ([(1, "stalled"), (1, "stalled")], True), ([(9, "failed")], False)):
        status = spark.createDataFrame(history, "source_id long, status string")
        assert M.source_health(status, sources).first().restart is want


def test_series_of_nothing(spark, samples):
    none = samples.limit(0)
    assert not M.trailing_qps(none).count() and not M.rolling_stats(none).count() and not M.latency_stats(none).count()
