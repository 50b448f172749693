"""Registered pricing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import percent
from ..operators import pricing as P
from .oracle import pricing_sql
from .registry import on_model, register


@register("recent_prices", pricing_sql("SELECT product_id, CAST(list_sum(newest) AS DOUBLE) / list_count(newest) AS avg_price FROM sold"),
          ids="V1 W3 A1 J4")
@on_model
def recent_prices(m):
    return P.recent_prices(m)


@register("promotion_effect",
          pricing_sql("SELECT product_id, CAST(percent_off AS DOUBLE) AS promotion_discount FROM best_offer"),
          ids="V2 P7 J1 A2")
@on_model
def promotion_effect(m):
    return P.promotion_effect(m).select(
        "product_id", percent(F.col("promotion_discount")).alias("promotion_discount"))


@register("popularity_rank",
          pricing_sql("SELECT product_id, category_id, place AS popularity_rank, n AS sale_count "
                      "FROM selling JOIN selling_place USING (category_id, n)"),
          ids="V3 W1 A3 J1")
@on_model
def popularity_rank(m):
    return P.popularity_rank(m)


@register("inventory_status",
          pricing_sql("SELECT product_id, units AS total_stock, place AS stock_rank "
                      "FROM held JOIN held_place USING (units)"),
          ids="V4 A4 W2")
@on_model
def inventory_status(m):
    return P.inventory_status(m)


@register("stock_rank_top",
          pricing_sql("SELECT product_id, units AS total_stock, place AS stock_rank "
                      "FROM held JOIN held_place USING (units) WHERE place <= 10"),
          ids="W2")
@on_model
def stock_rank_top(m):
    return P.stock_rank_top(m)


@register("high_demand",
          pricing_sql("""
SELECT product_id, CAST(paid AS DOUBLE) / priced AS avg_sale_price, n AS total_sales
FROM (SELECT *, sum(n) OVER () AS all_sales, count(*) OVER () AS sold
      FROM (SELECT product_id, count(*) AS n, sum(sale_price) AS paid, count(sale_price) AS priced
            FROM sales GROUP BY product_id))
WHERE n * sold > all_sales AND product_id IN (SELECT product_id FROM products)"""),
          ids="V5 A5 A6")
@on_model
def high_demand(m):
    return P.high_demand(m)


@register("dynamic_pricing", pricing_sql("SELECT product_id, adjusted_price, last_update_time FROM live_price"),
          ids="V6 P1 P2 P3 P4 P5 P6 J2 J3 J5 F1 F9 F10")
@on_model
def dynamic_pricing(m):
    return P.dynamic_pricing(m)


@register("pricing_factors",
          pricing_sql("""
SELECT product_id, selling_place AS popularity_rank, by_popularity AS popularity_adjustment,
       by_promotion AS promotion_discount, by_stock AS stock_adjustment,
       by_demand AS demand_multiplier, by_name AS additional_discount
FROM weighed"""),
          ids="P1 P2 P3 P4 P5")
@on_model
def pricing_factors(m):
    # the price itself only needs ranks up to 10 (bounded top-k); the report shows every rank
    f = P.pricing_factors(m).drop("popularity_rank")
    return (f.join(P.popularity_rank(m).select("product_id", "popularity_rank"), "product_id")
            .select("product_id", "popularity_rank", "popularity_adjustment", "promotion_discount",
                    "stock_adjustment", "demand_multiplier", "additional_discount"))


@register("price_point_lookup",
          pricing_sql("SELECT product_id, adjusted_price, last_update_time FROM live_price WHERE product_id = 1"),
          ids="P8")
@on_model
def price_point_lookup(m):
    return P.price_point_lookup(m, 1)
