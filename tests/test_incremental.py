"""Incremental maintenance equals full recompute, however the changes are batched."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import day, make_model
from livepricing.operators import cart as C
from livepricing.operators import hierarchy as H
from livepricing.operators.pricing import dynamic_pricing
from livepricing.streaming.jobs import apply_changes, change_records, pinned_cart_summary
from livepricing.streaming.maintained import RESERVE, SET_SHIFT, MaintainedViews
from livepricing.streaming.store import SnapshotStore

CATEGORIES = [(1, "food", None), (2, "dairy", 1), (3, "milk", 2), (4, "cheese", 2), (5, "tools", None), (6, "saws", 5)]
PRODUCTS = [(i, f"{'cheap ' if i % 4 == 0 else ''}p{i}", 1000 + 37 * i, 1 + i % 6) for i in range(24)]
NAMES = {p[0]: p[1] for p in PRODUCTS}


def base(rng):
    sales, n = [], 0
    for p in range(24):
        for _ in range(rng.choice([0, 1, 3, 12]) if p else RESERVE + 40):   # product 0 hides most of its sales
            sales.append((n, p, rng.randrange(500, 3000), rng.randrange(60)))
            n += 1
    promos = [(p, rng.choice([500, 1000, 2500]), rng.random() < .5) for p in range(0, 24, 2) for _ in range(rng.choice([1, 3]))]
    inv = [(p, rng.randrange(30)) for p in range(0, 24, 3) for _ in range(rng.choice([1, 2]))]
    cart = [(p, NAMES[p], p % 5) for p in (0, 1, 2, 3, 3, 9, 11)]
    return sales, promos, inv, cart


def feed(rng, sales, n):
    """Changes with seq, among them deletes of base sales and of sales inserted earlier."""
    out, alive, next_id = [], list(sales), 1000
    for seq in range(n):
        kind, p = rng.choice(["sale", "unsale", "toggle", "delta", "update", "add", "cut"]), rng.randrange(24)
        if kind == "sale":
            row = (next_id, p, rng.randrange(500, 3000), rng.randrange(40, 90))
            next_id += 1
            alive.append(row)
            out.append((seq, "sales", (*row, 1)))
        elif kind == "unsale":
            row = alive.pop(rng.randrange(len(alive)))
            out.append((seq, "sales", (*row, -1)))
        elif kind == "toggle":
            out.append((seq, "toggles", (rng.choice([p, 99]),)))
        elif kind == "delta":
            out.append((seq, "ops", (p, 0, rng.randrange(-9, 8))))
        elif kind == "update":
            out.append((seq, "updates", (p, rng.randrange(500, 4000), rng.randrange(1, 7), seq)))
        elif kind == "add":
            out.append((seq, "adds", (p, rng.randrange(6))))
            out.append((seq, "ops", (p, rng.randrange(5, 26), SET_SHIFT)))
        else:
            out.append((seq, "cuts", (rng.randrange(6),)))
    return out


def frames(spark, changes):
    make = {
        "sales": (lambda s, v: (v[1], v[0], v[2], v[2], day(v[3]), v[4]), "product_id long, sale_id long, price long, sale_price long, sale_date timestamp_ntz, n int"),
        "toggles": (lambda s, v: (v[0], s), "product_id long, seq long"),
        "ops": (lambda s, v: (v[0], s, v[1], v[2]), "product_id long, seq long, a long, b long"),
        "updates": (lambda s, v: (v[0], s, v[1], v[2], day(v[3])), "product_id long, seq long, base_price long, category_id long, last_update_time timestamp_ntz"),
        "adds": (lambda s, v: (v[0], day(v[1]), s), "product_id long, ts timestamp_ntz, seq long"),
        "cuts": (lambda s, v: (day(v[0]), s), "ts timestamp_ntz, seq long"),
    }
    out = {}
    for kind, (row, ddl) in make.items():
        rows = [row(s, v) for s, k, v in changes if k == kind]
        if rows:
            out[kind] = spark.createDataFrame(rows, ddl)
    return out


def final_model(spark, start, changes):
    """The tables after all changes, one after the other."""
    sales, promos, inv, cart = ([list(r) for r in x] for x in start)
    products = {p[0]: list(p) + [None] for p in PRODUCTS}
    cart = [(*r, -1) for r in cart]
    cuts = {}
    for seq, kind, v in sorted(changes, key=lambda x: (x[0], x[1] == "ops")):
        if kind == "sales" and v[-1] == 1:
            sales.append(list(v[:-1]))
        elif kind == "sales":
            sales.remove(list(v[:-1]))
        elif kind == "toggles" and v[0] in NAMES:
            mine = [r for r in promos if r[0] == v[0]]
            for r in mine:
                r[2] = not r[2]
            if not mine:
                promos.append([v[0], 1000, True])
        elif kind == "ops":
            mine = [r for r in inv if r[0] == v[0]]
            for r in mine:
                r[1] = max(v[1], r[1] + v[2])
            if not mine and v[2] == SET_SHIFT:
                inv.append([v[0], v[1]])
        elif kind == "updates":
            products[v[0]][2:5] = [v[1], v[2], v[3]]
        elif kind == "adds":
            cart.append((v[0], NAMES[v[0]], v[1], seq))
        elif kind == "cuts":
            cart = [r for r in cart if r[2] != v[0]]
    m = make_model(spark, [tuple(p[:4]) for p in products.values()], [tuple(s) for s in sales], [tuple(p) for p in promos],
                   [tuple(i) for i in inv], CATEGORIES, [r[:3] for r in cart])
    return m


def rows(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def check(views, m, version=None):
    lines = C.cart_lines(m)
    assert rows(views.prices(version), "product_id", "adjusted_price") == rows(dynamic_pricing(m), "product_id", "adjusted_price")
    assert rows(views.cart_lines(version), *lines.columns) == rows(lines, *lines.columns)
    want = H.category_totals(m, lines)
    assert rows(views.category_totals(version), *want.columns) == rows(want, *want.columns)


def views_over(spark, start, **options):
    m = make_model(spark, PRODUCTS, *start[:3], CATEGORIES, start[3])
    views = MaintainedViews(spark, m, SnapshotStore(spark, tempfile.mkdtemp(prefix="lp-views-")), **options)
    views.bootstrap()
    return views


@pytest.mark.parametrize("seed", [2])
def test_any_batches_in_any_order_equal_full_recompute(spark, seed):
    rng = random.Random(seed)
    start = base(rng)
    changes = feed(rng, start[0], 150)
    # product 0 loses so many of its newest sales that its reserve runs dry
    newest = sorted((s for s in start[0] if s[1] == 0), key=lambda s: (s[3], s[0]), reverse=True)
    dropped = {v[0] for _, k, v in changes if k == "sales" and v[-1] == -1}
    changes += [(1000 + i, "sales", (*s, -1)) for i, s in enumerate(s for s in newest[:RESERVE - 3] if s[0] not in dropped)]
    views = views_over(spark, start, compact_every=2)
    check(views, final_model(spark, start, []))
    rng.shuffle(changes)     # deletes come before their inserts, deltas late
    cuts = [0, 90, 93, len(changes)]
    for v, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
        views.apply(frames(spark, changes[a:b]), v)
    assert views.store.base_of(3) == 2
    check(views, final_model(spark, start, changes))


def test_versions_follow_the_batch_and_old_ones_stay_readable(spark):
    rng = random.Random(4)
    start = base(rng)
    views = views_over(spark, start, compact_every=3)
    store = views.store
    small = [(0, "toggles", (2,))]
    large = feed(rng, start[0], 80)
    views.apply(frames(spark, small), 1)
    written = lambda v: sum(spark.read.parquet(store.path(t, v)).count() for t in [*views.tables, *views.logs])
    assert written(1) <= 6   # the promotion, its price, at most one line and its ancestors
    views.apply(frames(spark, [(s + 1, k, v) for s, k, v in large]), 2)
    assert written(2) > 10 * written(1)
    views.apply({}, 3)       # an empty batch changes nothing, and is the third since the base
    assert written(3) == 0 and store.base_of(3) == 3
    # a reader that pinned version 1 reads it whole although newer ones are committed
    check(views, final_model(spark, start, small), version=1)
    assert pinned_cart_summary(views, 1).first()["version"] == 1
    assert store.expire(keep=2) == []          # version 2 still builds upon version 0
    views.apply(frames(spark, [(500, "toggles", (2,))]), 4)
    assert store.expire(keep=2) == [0, 1, 2]
    check(views, final_model(spark, start, small + [(s + 1, k, v) for s, k, v in large] + [(500, "toggles", (2,))]))


def test_signed_promotions(spark):
    """Counted multisets: a discount goes only with its last row."""
    views = views_over(spark, ([(1, 5, 1000, 1)], [(5, 500, True), (5, 500, True), (5, 2000, True)], [], []))
    signed = "product_id long, promotion_discount long, active boolean, n long"
    price = lambda: views.prices().where("product_id = 5").first()["adjusted_price"]
    first = price()
    views.apply({"promotions": spark.createDataFrame([(5, 500, True, -1)], signed)}, 1)
    assert price() == first
    views.apply({"promotions": spark.createDataFrame([(5, 500, True, -1)], signed)}, 2)
    assert price() == pytest.approx(first / 0.95 * 0.8, abs=1e-5)


def test_replica_keeps_last_change_and_drops_deletes(spark):
    ev = spark.createDataFrame(
        [(1, 10, "view", 1.0), (1, 11, "error", 2.0), (2, 12, "click", 3.0), (2, 13, "view", 4.0),
         (3, 14, "error", 5.0)], "user_id long, event_id long, event_type string, value double")
    empty = spark.createDataFrame([], "key long, seq long, event_type string, value double")
    out = apply_changes(empty, change_records(ev))
    assert sorted(tuple(r) for r in out.select("key", "seq", "event_type").collect()) == [(2, 13, "view")]


@pytest.mark.parametrize("seed", [5])
def test_batches_without_broadcasts_equal_full_recompute(spark, seed):
    """As on large tables: every join sorts and merges, and partitions are not merged."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rng = random.Random(seed)
        start = base(rng)
        changes = feed(rng, start[0], 30)
        views = views_over(spark, start)
        views.apply(frames(spark, changes), 1)
        check(views, final_model(spark, start, changes))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
