"""The change feed over the driver tables: events -> signed changes of the model's tables.

purchase: a sale; error: a promotion toggle; click: a stock delta; signup: a cart add, which also
restocks; view: by event id, a new price and category of a product, a cart delete by ts, or the
deletion of a sale (a whole order of the base table, or the sale of the purchase just before it;
the deleted row comes along as a change feed's before-image).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as CH
from ..sources.model import driver_sales, read_table
from .maintained import SET_SHIFT

KEY = "try_cast(get_json_object(props, '$.k') AS BIGINT)"


def event_sales(ev: DataFrame) -> DataFrame:
    """purchase -> a new sale of product k at the event value."""
    c = F.round(F.col("value") * 100).cast("bigint")
    return ev.where(F.col("event_type") == "purchase").select(
        F.expr(KEY).alias("product_id"), c.alias("price"), c.alias("sale_price"),
        F.col("ts").alias("sale_date"), F.col("event_id").alias("order_key"),
        F.lit(0).alias("line_no"))


def event_toggles(ev: DataFrame) -> DataFrame:
    """error -> a promotion toggle of product k."""
    return ev.where(F.col("event_type") == "error").select(
        F.expr(KEY).alias("product_id"), F.col("event_id").alias("seq"))


def event_stock_deltas(ev: DataFrame) -> DataFrame:
    """click -> a stock delta of -5..+5 on product k."""
    return ev.where(F.col("event_type") == "click").select(
        F.expr(KEY).alias("product_id"), F.col("event_id").alias("seq"),
        ((F.col("event_id") % 11) - 5).cast("int").alias("delta"))


def event_cart_adds(ev: DataFrame) -> DataFrame:
    """signup -> a cart line of product k, its ts cut to the hour."""
    return ev.where(F.col("event_type") == "signup").select(
        F.expr(KEY).alias("product_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"))


def views(ev: DataFrame, kind: int) -> DataFrame:
    return ev.where((F.col("event_type") == "view") & (F.col("event_id") % 5 == kind))


def event_updates(ev: DataFrame, n_suppliers) -> DataFrame:
    """view 0 -> product k gets a price from the event value and a supplier's category."""
    return views(ev, 0).select(
        F.expr(KEY).alias("product_id"), F.col("event_id").alias("seq"), (F.round(F.col("value") * 100).cast("bigint") + 100).alias("base_price"),
        (10001 + F.col("event_id") % n_suppliers).cast("bigint").alias("category_id"), F.col("ts").alias("last_update_time"))


def event_cart_cuts(ev: DataFrame) -> DataFrame:
    """view 1 -> a delete of the cart lines of its hour so far."""
    return views(ev, 1).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"))


def event_changes(ev: DataFrame, sf_dir: str) -> dict[str, DataFrame]:
    """Signed changes of one batch of events. Deleted rows are looked up in the base tables."""
    spark = ev.sparkSession
    orders = views(ev, 2).select(F.col("event_id").alias("order_key")).distinct()
    gone = driver_sales(spark, sf_dir).join(orders, "order_key", "left_semi")
    before = views(ev, 3).select((F.col("event_id") - 1).alias("event_id")).distinct()
    undone = event_sales(read_table(spark, sf_dir, "events").join(before, "event_id", "left_semi"))
    own = F.col("order_key").cast("long").alias("seq")      # the event behind each change
    sales = event_sales(ev).select("*", own, F.lit(1).alias("n"))
    sales = sales.unionByName(gone.select("*", own, F.lit(-1).alias("n")))
    sales = sales.unionByName(undone.select("*", own + 1, F.lit(-1).alias("n")).toDF(*sales.columns))
    delta = F.col("delta").cast("long")
    ops = (event_stock_deltas(ev).select("product_id", "seq", F.lit(0).cast("long").alias("a"), delta.alias("b"))
           .unionByName(event_cart_adds(ev).select("product_id", "seq", CH.draw_stock(F.col("seq")).cast("long").alias("a"), F.lit(SET_SHIFT).cast("long").alias("b"))))
    n_suppliers = read_table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    known = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"))
    existing = lambda df: df.join(known, "product_id", "left_semi")
    return {"sales": sales, "toggles": event_toggles(ev), "ops": existing(ops), "updates": existing(event_updates(ev, n_suppliers)),
            "adds": event_cart_adds(ev), "cuts": event_cart_cuts(ev)}
