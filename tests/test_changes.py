"""Change-event fixtures."""

import random

from pyspark.sql import functions as F

from livepricing.operators import changes as CH


def test_stock_deltas_clamp_step_by_step(spark):
    inv = spark.createDataFrame([(1, 9, 2), (1, 8, 10), (2, 9, 4)],
                                "product_id bigint, warehouse_id bigint, stock int")
    deltas = spark.createDataFrame([(1, 1, -5), (1, 2, 3)], "product_id bigint, seq bigint, delta int")
    got = {(r.product_id, r.warehouse_id): r.stock for r in CH.apply_stock_deltas(inv, deltas).collect()}
    # 2 -> max(0, -3) = 0 -> 3 (not 0); 10 -> 5 -> 8; product 2 untouched
    assert got == {(1, 9): 3, (1, 8): 8, (2, 9): 4}


def test_stock_deltas_match_sequential_fold_across_buckets(spark):
    rnd = random.Random(3)
    deltas = [(rnd.randint(1, 3), seq, rnd.randint(-6, 6)) for seq in range(300)]
    stocks = [(p, w, rnd.randint(0, 12)) for p in (1, 2, 3, 4) for w in (1, 2)]
    inv = spark.createDataFrame(stocks, "product_id bigint, warehouse_id bigint, stock int")
    d = spark.createDataFrame(deltas, "product_id bigint, seq bigint, delta int")
    got = {(r.product_id, r.warehouse_id): r.stock
           for r in CH.apply_stock_deltas(inv, d, bucket_width=16).collect()}
    want = {}
    for p, w, s in stocks:
        for pid, _, delta in sorted(deltas, key=lambda t: t[1]):
            if pid == p:
                s = max(0, s + delta)
        want[(p, w)] = s
    assert got == want


def test_toggles_flip_insert_and_report_unknown(spark):
    promos = spark.createDataFrame([(1, 500, True), (1, 700, False)],
                                   "product_id bigint, promotion_discount bigint, active boolean")
    products = spark.createDataFrame([(1,), (2,), (3,)], "product_id bigint")
    toggles = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (3, 4), (99, 5)], "product_id bigint, seq bigint")
    now = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS as_of")
    new, status = CH.toggle_promotions(promos, products, toggles, now)
    rows = sorted((r.product_id, r.promotion_discount, r.active) for r in new.collect())
    # product 1 flips both rows; 2 gets a new active 10 %; 3 is inserted then toggled off
    assert rows == [(1, 500, False), (1, 700, True), (2, 1000, True), (3, 1000, False)]
    st = {r.product_id: r.status for r in status.collect()}
    assert st == {1: "success", 2: "success", 3: "success", 99: "error"}
    assert {r.product_id: r.active for r in status.collect()} == {1: True, 2: True, 3: False, 99: None}


def test_toggles_touch_updated_at(spark):
    promos = spark.sql("SELECT 1L AS product_id, 500L AS promotion_discount, true AS active, TIMESTAMP_NTZ '2023-01-01' AS updated_at"
                       " UNION ALL SELECT 4L, 500L, true, TIMESTAMP_NTZ '2023-01-01'")
    products = spark.createDataFrame([(1,), (4,)], "product_id bigint")
    toggles = spark.createDataFrame([(1, 1), (1, 2)], "product_id bigint, seq bigint")
    now = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS as_of")
    new, status = CH.toggle_promotions(promos, products, toggles, now)
    # two toggles leave the flag, but the row was written; product 4 was not toggled
    assert {r.product_id: (r.active, r.updated_at.year) for r in new.collect()} == {1: (True, 2024), 4: (True, 2023)}
    assert [r.updated_at.year for r in status.collect()] == [2024]


def test_seeded_pick_does_not_depend_on_partitions(spark):
    rows = spark.range(1000).withColumnRenamed("id", "product_id")
    one = CH.seeded_pick(rows.repartition(1), "product_id", 3).collect()
    assert one == CH.seeded_pick(rows.repartition(13), "product_id", 3).collect() and len(one) == 1
    assert one != CH.seeded_pick(rows, "product_id", 4).collect()
    assert not CH.seeded_pick(rows.limit(0), "product_id", 3).count()


def test_upsert_and_insert_ignore(spark):
    cur = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    upd = spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int")
    assert sorted(tuple(r) for r in CH.upsert(cur, upd, "k").collect()) == [("a", 1), ("b", 5), ("c", 6)]
    assert sorted(tuple(r) for r in CH.insert_ignore(cur, upd, "k").collect()) == [("a", 1), ("b", 2), ("c", 6)]


def test_next_ids_follow_max_in_seq_order(spark):
    existing = spark.createDataFrame([(7,), (3,)], "product_id bigint")
    new = spark.createDataFrame([("x", 30), ("y", 10), ("z", 20)], "product_name string, seq bigint")
    got = {r.product_name: r.product_id for r in CH.next_ids(new, existing, "product_id", "seq", "product_id").collect()}
    assert got == {"y": 8, "z": 9, "x": 10}


def test_cart_delete_removes_every_row_with_the_ts(spark):
    cart = spark.createDataFrame([(1, "t1"), (2, "t1"), (3, "t2")], "product_id bigint, ts string")
    out = CH.cart_delete(cart, spark.createDataFrame([("t1",)], "ts string"))
    assert [r.product_id for r in out.collect()] == [3]


def test_insert_ignore_first_of_batch_wins(spark):
    cur = spark.createDataFrame([("a", 1, 0)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 7, 2), ("b", 5, 1), ("a", 9, 0)], "k string, v int, seq int")
    got = sorted(tuple(r) for r in CH.insert_ignore(cur, new, "k", order="seq").collect())
    assert got == [("a", 1, 0), ("b", 5, 1)]


def test_insert_ignore_without_order_is_defined(spark):
    cur = spark.createDataFrame([("a", 1, "x")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 7, "p"), ("b", 5, "r"), ("b", 5, "q")], cur.schema)
    for n in (1, 3):
        got = sorted(tuple(r) for r in CH.insert_ignore(cur, new.repartition(n), "k").collect())
        assert got == [("a", 1, "x"), ("b", 5, "q")]
