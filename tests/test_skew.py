"""A third of all rows on one key: results stay exact (the plans bound the hot key)."""

import datetime as dt
import random

from helpers import make_model
from livepricing.operators import metrics as M
from livepricing.operators import ordered as O
from livepricing.operators import pricing as P


def test_hot_product_recent_prices_and_rank(spark):
    rnd = random.Random(11)
    n = 900
    sales = []
    for sid in range(n):
        pid = 1 if sid % 3 == 0 else rnd.randint(2, 40)     # product 1 holds a third
        sales.append((sid, pid, rnd.randint(100, 999), rnd.randint(0, 60)))
    products = [(p, f"p{p}", 500, 7 if p % 2 else 8) for p in range(1, 41)]
    m = make_model(spark, products, sales)
    got = {r.product_id: r.avg_price for r in P.recent_prices(m).collect()}
    for pid in (1, 2, 17):
        mine = sorted((s for s in sales if s[1] == pid), key=lambda s: (s[3], s[0]), reverse=True)[:10]
        assert abs(got[pid] - sum(s[2] for s in mine) / 100.0 / len(mine)) < 1e-9
    ranks = {r.product_id: r.popularity_rank for r in P.popularity_rank(m).collect()}
    assert ranks[1] == 1


def test_hot_source_carry_forward(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        user = 1 if i % 3 == 0 else 2 + i % 5
        src = "error" if i % 7 == 0 else "view"
        rows.append((src, t0 + dt.timedelta(minutes=i * 17), float(i), i, user))
    s = spark.createDataFrame(rows, "source string, ts timestamp_ntz, latency double, seq long, user_id long")
    got = {r.seq: r.price_filled for r in M.carry_forward(M.price_series(s)).collect()}
    last = {}
    for src, ts, v, seq, user in rows:
        if src != "error":
            last[user] = v
        assert got[seq] == last.get(user)


def test_blocks_are_even_with_a_third_of_the_rows_in_one_second(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 == 0 else f"s{i % 5}", t0 + dt.timedelta(microseconds=i * 10 if i % 3 == 0 else i * 10 ** 6), i) for i in range(30_000)]
    s = spark.createDataFrame(rows, "source string, ts timestamp_ntz, seq long").repartition(6)
    sizes = [r.n for r in O.in_blocks(s, ["source"], ["ts", "seq"]).groupBy("_blk").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) >= 14 and max(sizes) <= 2 * len(rows) / len(sizes)
    got = {r.seq: r.queries for r in M.trailing_qps(s).where("source = 'hot'").collect()}
    assert got == {i: n + 1 for n, i in enumerate(range(0, 30_000, 3))}     # all within one second
    numbers = O.numbered(s, ["source"], ["ts", "seq"]).where("source = 'hot'").collect()
    assert all(r._pos == r.seq // 3 for r in numbers)
