"""Hand-made fixtures pinning the pricing semantics."""

import pytest

from helpers import make_model
from livepricing.operators import pricing as P


def prices(df):
    return {r["product_id"]: r["adjusted_price"] for r in df.collect()}


def test_products_without_sales_vanish_and_missing_factors_are_one(spark):
    # product 1 has a sale, no promotion, no stock; product 2 has no sale
    m = make_model(spark, products=[(1, "a", 1000, 7), (2, "b", 1000, 7)],
                   sales=[(1, 1, 1000, 0)])
    got = prices(P.dynamic_pricing(m))
    assert set(got) == {1}
    # rank 1 in its category -> 1.2; no promotion -> 1; no stock -> 1; demand 1
    assert got[1] == pytest.approx(10.0 * 1.2)


def test_smallest_active_discount_wins_dates_ignored(spark):
    m = make_model(spark, products=[(1, "a", 1000, 7)], sales=[(1, 1, 1000, 0)],
                   promotions=[(1, 500, True), (1, 2000, True), (1, 100, False)])
    eff = {r["product_id"]: r["promotion_discount"] for r in P.promotion_effect(m).collect()}
    assert eff == {1: 500}
    assert prices(P.dynamic_pricing(m))[1] == pytest.approx(10.0 * 1.2 * 0.95)


def test_rank_has_gaps_after_ties(spark):
    # category 7: counts 3, 3, 1 -> ranks 1, 1, 3
    sales = [(i, pid, 100, i) for i, pid in enumerate([1, 1, 1, 2, 2, 2, 3])]
    m = make_model(spark, products=[(1, "a", 100, 7), (2, "b", 100, 7), (3, "c", 100, 7)],
                   sales=sales)
    ranks = {r["product_id"]: r["popularity_rank"] for r in P.popularity_rank(m).collect()}
    assert ranks == {1: 1, 2: 1, 3: 3}


def test_rank_above_ten_gets_point_nine_and_null_stock_rank_is_one(spark):
    # 12 products in one category with distinct counts 12..1; only product 1 has stock
    products = [(i, f"p{i}", 1000, 7) for i in range(1, 13)]
    sales, sid = [], 0
    for pid in range(1, 13):
        for _ in range(13 - pid):
            sid += 1
            sales.append((sid, pid, 1000, sid))
    m = make_model(spark, products=products, sales=sales, inventory=[(1, 5)])
    f = {r["product_id"]: r for r in P.pricing_factors(m).collect()}
    assert f[1]["popularity_adjustment"] == 1.2 and f[4]["popularity_adjustment"] == 1.1
    assert f[11]["popularity_adjustment"] == 0.9 and f[11]["popularity_rank"] is None
    assert f[1]["stock_adjustment"] == 1.1      # the only stocked product ranks 1
    assert f[2]["stock_adjustment"] == 1.0      # no stock row -> NULL rank -> 1


def test_recent_prices_take_ten_newest_with_total_tiebreak(spark):
    # 12 sales; dates 0..10 with a tie on day 2 between sale 3 (price 1000) and 4 (price 0)
    sales = [(1, 1, 0, 0), (2, 1, 0, 1), (3, 1, 1000, 2), (4, 1, 0, 2)]
    sales += [(4 + k, 1, 100, 2 + k) for k in range(1, 9)]
    m = make_model(spark, products=[(1, "a", 100, 7)], sales=sales)
    avg = P.recent_prices(m).collect()[0]["avg_price"]
    # the 8 newest (1.00 each) then day 2: sale 4 before sale 3 (sale_id desc)
    assert avg == pytest.approx((8 * 1.0 + 0.0 + 10.0) / 10)


def test_keyword_discount_is_case_insensitive(spark):
    m = make_model(spark, products=[(1, "Very CHEAP tea", 1000, 7)], sales=[(1, 1, 1000, 0)])
    assert prices(P.dynamic_pricing(m))[1] == pytest.approx(10.0 * 1.2 * 0.8)


def test_point_lookup_equals_full_view(spark):
    products = [(i, f"p{i}", 1000 + i, 7 + i % 2) for i in range(1, 9)]
    sales = [(k, 1 + k % 8, 900 + k, k) for k in range(40)]
    m = make_model(spark, products=products, sales=sales, inventory=[(3, 9), (5, 2)],
                   promotions=[(4, 1000, True)])
    full = prices(P.dynamic_pricing(m))
    for pid in (1, 4, 5):
        assert prices(P.price_point_lookup(m, pid)) == {pid: full[pid]}
