"""Tiny in-memory models for hand-made fixtures."""

import datetime as dt

from livepricing.sources.model import Model

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def make_model(spark, products, sales, promotions=(), inventory=(), categories=(), cart=(),
               keyword="cheap"):
    """products: (id, name, base_cents, category); sales: (sale_id, product, price_cents, day);
    promotions: (product, hundredths_pct, active); inventory: (product, stock);
    categories: (id, name, parent); cart: (product, name, day)."""
    p = spark.createDataFrame(
        [(i, n, b, c, T0) for i, n, b, c in products],
        "product_id bigint, product_name string, base_price bigint, category_id bigint, "
        "last_update_time timestamp_ntz")
    s = spark.createDataFrame(
        [(sid, pid, pr, pr, day(d)) for sid, pid, pr, d in sales],
        "sale_id bigint, product_id bigint, price bigint, sale_price bigint, sale_date timestamp_ntz")
    pr = spark.createDataFrame(list(promotions) or [(None, None, None)],
                               "product_id bigint, promotion_discount bigint, active boolean"
                               ).where("product_id IS NOT NULL")
    inv = spark.createDataFrame(list(inventory) or [(None, None)],
                                "product_id bigint, stock int").where("product_id IS NOT NULL")
    cats = spark.createDataFrame(list(categories) or [(None, None, None)],
                                 "category_id bigint, category_name string, parent_id bigint"
                                 ).where("category_id IS NOT NULL")
    c = spark.createDataFrame([(pid, n, day(d)) for pid, n, d in cart] or [(None, None, None)],
                              "product_id bigint, product_name string, ts timestamp_ntz"
                              ).where("product_id IS NOT NULL")
    c = c.join(p.select("product_id", "category_id", "base_price"), "product_id").withColumnRenamed(
        "base_price", "price")
    return Model(products=p, sales=s, promotions=pr, inventory=inv, categories=cats,
                 shopping_cart=c, sale_tiebreak=("sale_id",), discount_keyword=keyword)
