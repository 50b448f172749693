"""Property tests (hypothesis): the skew-safe operators equal their naive sequential form."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from livepricing.operators import changes as CH
from livepricing.operators.ordered import ordered_fill

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

series = st.lists(st.tuples(st.integers(0, 2),                       # key (0 is hot)
                            st.integers(0, 500),                     # minute offset
                            st.one_of(st.none(), st.integers(-50, 50))),
                  min_size=1, max_size=60)


@SETTINGS
@given(rows=series)
def test_ordered_fill_equals_sequential(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [(k, t0 + dt.timedelta(minutes=m), i, v) for i, (k, m, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k int, ts timestamp_ntz, seq int, v int")
    out = ordered_fill(df, ["k"], ["ts", "seq"], "v", prev_out="prev", last_out="last")
    got = {r.seq: (r.prev, r.last) for r in out.collect()}
    want = {}
    for k in {r[0] for r in data}:
        prev, last = None, None
        for key, ts, seq, v in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2])):
            if v is not None:
                last = v
            want[seq] = (prev, last)
            prev = v
    assert got == want


deltas = st.lists(st.tuples(st.integers(1, 3), st.integers(-9, 9)), min_size=1, max_size=50)


@SETTINGS
@given(ds=deltas, width=st.sampled_from([1, 3, 16, 1 << 20]),
       stocks=st.lists(st.integers(0, 15), min_size=3, max_size=3))
def test_delta_composition_equals_fold(spark, ds, width, stocks):
    inv = [(p, 1, s) for p, s in zip((1, 2, 3), stocks)]
    d = [(p, seq, delta) for seq, (p, delta) in enumerate(ds)]
    got = {r.product_id: r.stock for r in CH.apply_stock_deltas(
        spark.createDataFrame(inv, "product_id bigint, warehouse_id bigint, stock int"),
        spark.createDataFrame(d, "product_id bigint, seq bigint, delta int"), bucket_width=width).collect()}
    want = {}
    for p, _, s in inv:
        for pid, _, delta in d:
            if pid == p:
                s = max(0, s + delta)
        want[p] = s
    assert got == want
