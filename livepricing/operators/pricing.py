"""The dynamic-pricing views (recent prices, promotions, popularity, stock, demand) and
the flagship per-product adjusted price.

Every function takes a ``Model`` and returns a DataFrame; nothing is collected.
``restrict_to`` prices only some products, exactly. It is a list of ids a caller names (a
literal IN pushed into the Parquet scans) or a DataFrame of ids (semi-joins). The
per-product parts read only those products; popularity is ranked over every product of
the categories involved, counting only those products' sales; the stock rank stays
global.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pricing_exprs as X
from ..functions.money import exact_avg, money
from ..session import stage_table
from ..sources.model import RANK_NEAR, RECENT_SALES, Model
from .ranking import full_rank, top_k_per_group, top_k_rank


def in_list(col: str, keys) -> "F.Column":
    """``col IN (k1, k2, ...)`` as one SQL expression (one JVM call, not one per key)."""
    keys = sorted({int(k) for k in keys})
    if not keys:
        return F.lit(False)
    return F.expr(f"`{col}` IN ({', '.join(str(k) for k in keys)})")


def restrict(df: DataFrame, keys, col: str = "product_id") -> DataFrame:
    """Keep rows whose key is in ``keys``: a list of ids (a literal IN, pushed down to the
    Parquet scan) or a DataFrame of keys (a semi-join)."""
    if keys is None:
        return df
    if isinstance(keys, (list, tuple, set)):
        return df.where(in_list(col, keys))
    return df.join(keys.select(col).distinct(), col, "left_semi")


def recent_prices(m: Model, restrict_to=None,
                  k: int = RECENT_SALES) -> DataFrame:
    """V1: average price of each product's k most recent sales.

    Ties on sale_date are broken by the model's total tie-break order. The partial
    WindowGroupLimit keeps a hot product to k rows per map partition before the shuffle.
    """
    sales = restrict(m.sales, restrict_to).select("product_id", "price", "sale_date",
                                               *m.sale_tiebreak)
    top = top_k_per_group(sales, ["product_id"], m.sale_order_sql(), k)
    return top.groupBy("product_id").agg(exact_avg(F.col("price")).alias("avg_price"))


def promotion_effect(m: Model, restrict_to=None) -> DataFrame:
    """V2: smallest active discount per existing product (dates are ignored)."""
    best = (restrict(m.promotions, restrict_to).where(F.col("active"))
            .groupBy("product_id").agg(F.min("promotion_discount").alias("promotion_discount")))
    # aggregate first (partial min), then keep products that exist
    return best.join(m.products.select("product_id"), "product_id", "left_semi")


def sale_counts(m: Model) -> DataFrame:
    """Sales per product joined to its category (products without sales are absent)."""
    counts = m.sales.groupBy("product_id").agg(F.count(F.lit(1)).alias("sale_count"))
    return counts.join(m.products.select("product_id", "category_id"), "product_id")


def popularity_rank(m: Model) -> DataFrame:
    """V3: RANK of sales count within the category, for every product with sales."""
    # full_rank reads its input several times (histogram, bounds, join back): write the
    # products-sized counts once so the sales fact table is aggregated only once
    counts = stage_table(sale_counts(m), "sale-counts")
    ranked = full_rank(counts, ["category_id"], "sale_count", "popularity_rank")
    return ranked.select("product_id", "category_id",
                         F.col("popularity_rank").cast("bigint").alias("popularity_rank"),
                         "sale_count")


def stock_totals(m: Model) -> DataFrame:
    """Total stock per product. product_id is never NULL in the data model; saying so here
    gives the rank's two readers the same plan, so Spark runs the aggregate once."""
    return m.inventory.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.sum("stock").alias("total_stock"))


def inventory_status(m: Model) -> DataFrame:
    """V4: total stock per product and its global RANK (largest first)."""
    # as above: the inventory is aggregated once, the rank reads the small result
    totals = stage_table(stock_totals(m), "stock-totals")
    ranked = full_rank(totals, [], "total_stock", "stock_rank")
    return ranked.select("product_id", "total_stock",
                         F.col("stock_rank").cast("bigint").alias("stock_rank"))


def stock_rank_top(m: Model, k: int = RANK_NEAR) -> DataFrame:
    """W2 as the pricing needs it: products whose global stock rank is <= k."""
    ranked = top_k_rank(stock_totals(m), [], "total_stock", k, "stock_rank")
    return (ranked.where(F.col("stock_rank").isNotNull())
            .select("product_id", "total_stock",
                    F.col("stock_rank").cast("bigint").alias("stock_rank")))


def high_demand(m: Model) -> DataFrame:
    """V5: products sold more often than the average product (scalar subquery)."""
    # aggregate first (partial aggregates, a hot product collapses map-side), then keep
    # products that exist: the same rows as joining sales to products before grouping
    per = (m.sales.groupBy("product_id")
           .agg(exact_avg(F.col("sale_price")).alias("avg_sale_price"),
                F.count(F.lit(1)).alias("total_sales"))
           .join(m.products.select("product_id"), "product_id", "left_semi"))
    overall = (m.sales.groupBy("product_id").agg(F.count(F.lit(1)).alias("_c"))
               .agg(F.avg("_c")).scalar())       # scalar subquery
    return per.where(F.col("total_sales") > overall)


def assemble_factors(products: DataFrame, recent: DataFrame, promo: DataFrame,
                     pop: DataFrame, stock: DataFrame, keyword: str) -> DataFrame:
    """Every factor of the adjusted price from its parts, one row per product with a
    popularity row (i.e. with at least one sale).

    recent: (product_id, avg_price); promo: (product_id, promotion_discount) smallest
    active discount; pop: (product_id, popularity_rank) NULL above 10; stock: (product_id,
    stock_rank) only ranks <= 10. The batch view and the incrementally maintained view
    both price through here."""
    base = "CAST(base_price AS DOUBLE) / 100.0"
    joined = (products.select("product_id", "product_name", "base_price", "category_id",
                              "last_update_time")
              .join(recent, "product_id", "left")
              .join(promo, "product_id", "left")
              .join(pop, "product_id", "inner")
              .join(stock, "product_id", "left"))
    return joined.selectExpr(
        "product_id", "product_name", "category_id", "base_price", "last_update_time",
        "avg_price", "popularity_rank", "stock_rank",
        f"{X.popularity_sql('popularity_rank')} AS popularity_adjustment",
        f"{X.promotion_sql('promotion_discount')} AS promotion_discount",
        f"{X.stock_sql('stock_rank')} AS stock_adjustment",
        f"{X.demand_sql(base, 'avg_price')} AS demand_multiplier",
        f"{X.name_discount_sql('product_name', keyword)} AS additional_discount")


def prices_from_factors(f: DataFrame) -> DataFrame:
    price = X.adjusted_price_sql("CAST(base_price AS DOUBLE) / 100.0", "popularity_adjustment",
                                 "promotion_discount", "stock_adjustment", "demand_multiplier",
                                 "additional_discount")
    return f.selectExpr("product_id", f"{price} AS adjusted_price", "last_update_time")


def popularity_top(counts: DataFrame) -> DataFrame:
    """(product_id, popularity_rank): RANK within the category where it is <= 10."""
    return top_k_rank(counts, ["category_id"], "sale_count", RANK_NEAR,
                      "popularity_rank").select("product_id", "popularity_rank")


def stock_top(totals: DataFrame) -> DataFrame:
    """(product_id, stock_rank) for products whose global stock rank is <= 10."""
    ranked = top_k_rank(totals, [], "total_stock", RANK_NEAR, "stock_rank")
    return ranked.where(F.col("stock_rank").isNotNull()).select("product_id", "stock_rank")


def pricing_factors(m: Model, restrict_to=None) -> DataFrame:
    """Every factor of the adjusted price, one row per product that has sales."""
    products = restrict(m.products, restrict_to)
    if restrict_to is None:
        counts = sale_counts(m)
    else:
        # ranks need every product of the categories involved: restrict the sales to those
        # products *before* counting, so only their sales are aggregated
        cats = products.select("category_id").distinct()
        peers = m.products.join(cats, "category_id", "left_semi").select("product_id", "category_id")
        counts = (m.sales.join(peers.select("product_id"), "product_id", "left_semi")
                  .groupBy("product_id").agg(F.count(F.lit(1)).alias("sale_count"))
                  .join(peers, "product_id"))
    # only ranks <= 10 change the multiplier: bounded top-k rank per category
    pop = restrict(popularity_top(counts), restrict_to)
    promo = promotion_effect(m, restrict_to).select("product_id", "promotion_discount")
    return assemble_factors(products, recent_prices(m, restrict_to), promo, pop,
                            stock_top(stock_totals(m)), m.discount_keyword)


def dynamic_pricing(m: Model, restrict_to=None) -> DataFrame:
    """V6 (flagship): adjusted price per product with at least one sale."""
    return prices_from_factors(pricing_factors(m, restrict_to))


def price_point_lookup(m: Model, product_id: int) -> DataFrame:
    """One product's live price. Only that product's sales, promotions and its own
    category's counts are read; the stock rank stays global."""
    return dynamic_pricing(m, restrict_to=[int(product_id)])
