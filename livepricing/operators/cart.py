"""Shopping-cart views: cart lines at live prices, exact cart total, the cart document
and the cart summary message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import micros, round2_from_micros
from ..session import stage_table
from ..sources.model import Model
from . import hierarchy as H
from .pricing import dynamic_pricing, restrict

# Fixed values that must equal the reference's for the same results.
MESSAGE_TEMPLATE = "With the current items in your cart ($count$ items totaling $$total$),"


def cart_copies(m: Model) -> DataFrame:
    """product_id, product_name and how many rows of the cart hold them."""
    return (m.shopping_cart.groupBy("product_id", "product_name")
            .agg(F.count(F.lit(1)).alias("_copies")))


def stored_copies(m: Model) -> DataFrame:
    """`cart_copies`, written once: the six semi-joins of `cart_lines` then do not repeat the
    cart's own scans, and Spark knows the size of their keys before it plans them."""
    return stage_table(cart_copies(m), "cart-copies")


def cart_lines(m: Model, prices: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """V7: one row per (product, cart name) with its live price and available stock.

    Duplicate cart rows collapse into one line, and, as in the reference's grouping over
    cart x inventory, the stock sum counts once per duplicate cart row. Both sides are
    aggregated *before* the join (cart copies per product, stock per product), so no
    cart x inventory product is ever materialised. Prices are computed only for products
    in the cart (exactly: popularity is still ranked over their whole categories). ``copies``
    may be given as `stored_copies`; without it no job runs while the lines are built.
    """
    if copies is None:
        copies = cart_copies(m)
    # one form at every size: semi-joins on the cart's products; those of unknown size AQE turns
    # into broadcasts after measuring them
    in_cart = copies.select("product_id").distinct()
    if prices is None:
        prices = dynamic_pricing(m, restrict_to=in_cart)
    stock = (restrict(m.inventory, in_cart)
             .groupBy("product_id").agg(F.sum("stock").alias("_stock")))
    return (copies
            .join(m.products.select("product_id", "category_id"), "product_id")
            .join(m.categories.select("category_id", "category_name"), "category_id")
            .join(prices.select("product_id", F.col("adjusted_price").alias("price")), "product_id")
            .join(stock, "product_id", "left")
            .select("product_id", "product_name", "category_id", "category_name", "price",
                    F.coalesce(F.col("_copies") * F.col("_stock"), F.lit(0))
                    .cast("bigint").alias("available_stock")))


def cart_total(lines: DataFrame) -> DataFrame:
    """ROUND(SUM(price), 2) over the cart lines, exact; 0 for an empty cart."""
    return (lines.agg(F.coalesce(F.sum(micros(F.col("price"))), F.lit(0)).alias("_t"))
            .select(round2_from_micros("_t").alias("cart_total")))


def cart_items_sorted(lines: DataFrame) -> DataFrame:
    """O1: cart lines by price, most expensive first."""
    return lines.orderBy(F.col("price").desc(), "product_id", "product_name")


def cart_message(lines: DataFrame, template: str = MESSAGE_TEMPLATE) -> DataFrame:
    """A15 + P17: item count and total filled into the message template."""
    agg = lines.agg(F.count(F.lit(1)).alias("item_count"),
                    F.coalesce(F.sum(micros(F.col("price"))), F.lit(0)).alias("_t"))
    total = round2_from_micros("_t")
    msg = F.replace(F.replace(F.lit(template), F.lit("$count$"), F.col("item_count").cast("string")),
                    F.lit("$total$"), F.format_string("%.2f", total))
    return agg.select("item_count", total.alias("total"), msg.alias("message"))


def cart_document(m: Model, lines: DataFrame, expanded: str | None) -> DataFrame:
    """V9/IO16: the cart API response as JSON lines, one object per row: every cart item,
    every visible category subtotal, and one totals row. Each row is serialised on the
    executors; nothing is gathered into one record."""
    items = cart_items_sorted(lines).select(
        F.lit("cart_item").alias("section"),
        F.to_json(F.struct("product_id", "product_name", "category_id", "category_name",
                           "price", "available_stock")).alias("body"))
    totals_m = stage_table(H.category_totals_exact(m, lines), "category-totals")   # read three times
    subtotals = H.drilldown(m, lines, expanded, totals=totals_m).select(
        F.lit("category_subtotal").alias("section"),
        F.to_json(F.struct("category_id", "parent_id", "has_subcategory", "category_name",
                           "item_count", "subtotal", "categories_total")).alias("body"))
    grand = (totals_m.where(F.col("parent_id").isNull())
             .agg(F.coalesce(F.sum("total_m"), F.lit(0)).alias("_g"))
             .select(round2_from_micros("_g")).scalar())      # scalar subquery
    totals = (cart_total(lines)
              .select(F.lit("totals").alias("section"),
                      F.to_json(F.struct("cart_total", grand.alias("categories_total")))
                      .alias("body")))
    return items.unionByName(subtotals).unionByName(totals)


def cart_inventory(m: Model, exclude_product: int = 1) -> DataFrame:
    """Distinct (cart product, stock row) pairs the stock mutator walks, without
    the pinned product. The cart is reduced to its distinct products before the join."""
    products = (m.shopping_cart.where(F.col("product_id") != exclude_product)
                .select("product_id").distinct())
    return (products.join(m.inventory.select("product_id", "stock"), "product_id")
            .select("product_id", "stock").distinct())
