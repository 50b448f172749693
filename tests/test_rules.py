"""Remaining SURVEY 5.1 rules: S6 (which price each view averages), S8 (cart category from
products), T12 fan-out consistency."""

import pytest
from pyspark.sql import functions as F

from helpers import T0, make_model
from livepricing.operators import cart as C
from livepricing.operators import changes as CH
from livepricing.operators import pricing as P


def test_recent_averages_price_high_demand_averages_sale_price(spark):
    products = [(1, "a", 1000, 7), (2, "b", 1000, 7)]
    sales = [(1, 1, 1000, 0), (2, 1, 3000, 1), (3, 2, 500, 2)]
    m = make_model(spark, products, sales)
    # make sale_price differ from price
    m = m.with_tables(sales=m.sales.withColumn("sale_price", F.col("price") - 100))
    recent = {r.product_id: r.avg_price for r in P.recent_prices(m).collect()}
    assert recent[1] == pytest.approx(20.0)                      # (10 + 30) / 2, from price
    hd = {r.product_id: r.avg_sale_price for r in P.high_demand(m).collect()}
    assert hd == {1: pytest.approx(19.0)}                         # (9 + 29) / 2, from sale_price


def test_cart_category_comes_from_products(spark):
    cats = [(1, "root", None), (7, "seven", 1), (8, "eight", 1)]
    m = make_model(spark, [(10, "x", 1000, 7)], [(1, 10, 1000, 0)], categories=cats, cart=[(10, "x", 0)])
    # the cart row claims category 8; the product lives in 7
    m = m.with_tables(shopping_cart=m.shopping_cart.withColumn("category_id", F.lit(8).cast("bigint")))
    line = C.cart_lines(m).first()
    assert (line.category_id, line.category_name) == (7, "seven")


def test_new_products_fan_out_with_consecutive_ids(spark):
    products = spark.createDataFrame([(5,), (9,)], "product_id bigint")
    new = spark.createDataFrame([("n1", 7, 250, 30), ("n2", 8, 100, 10)],
                                "product_name string, category_id bigint, price bigint, seq bigint")
    out = CH.add_products(products, new, F.lit(T0).cast("timestamp_ntz"))
    prod = {r.product_name: r.product_id for r in out["products"].collect()}
    assert prod == {"n2": 10, "n1": 11}
    for table in ("sales", "inventory", "shopping_cart"):
        ids = sorted(r.product_id for r in out[table].collect())
        assert ids == [10, 11]
    stocks = [r.stock for r in out["inventory"].collect()]
    assert all(CH.NEW_STOCK_MIN <= s <= CH.NEW_STOCK_MAX for s in stocks)
