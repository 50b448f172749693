"""Registered streaming / incremental queries. Each drains the events
stream with ``availableNow`` into a snapshot store under the shared checkpoint folder and
returns the committed result; the oracle is the batch SQL over the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs as J
from .oracle import CART, HIERARCHY, MODEL, PRICING
from .queries_metrics import TRAILING_SQL
from .registry import model_for, register

K_SQL = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"

VIEW = "event_type = 'view' AND event_id % 5 ="

# the base model with the changing tables renamed, then their final state
FINAL_STATE = MODEL.replace("JOIN products p", "JOIN products0 p")
for _t in ("products", "sales", "promotions", "inventory", "shopping_cart"):
    FINAL_STATE = FINAL_STATE.replace(f"\n{_t} AS (", f"\n{_t}0 AS (")
FINAL_STATE += f""",
news AS (SELECT {K_SQL} AS product_id, arg_max(CAST(round(value * 100) AS BIGINT) + 100, event_id) AS price_c,
                10001 + max(event_id) % (SELECT count(*) FROM supplier) AS category_id, arg_max(ts, event_id) AS ts
         FROM events WHERE {VIEW} 0 GROUP BY 1),
products AS (
  SELECT p.product_id, p.product_name, coalesce(CAST(n.price_c / 100.0 AS DECIMAL(10,2)), p.base_price) AS base_price,
         coalesce(n.category_id, p.category_id) AS category_id, coalesce(n.ts, p.last_update_time) AS last_update_time
  FROM products0 p LEFT JOIN news n USING (product_id)),
sales AS (
  SELECT * FROM sales0 WHERE order_key NOT IN (SELECT event_id FROM events WHERE {VIEW} 2)
  UNION ALL
  SELECT {K_SQL}, CAST(value AS DECIMAL(12,2)), CAST(value AS DECIMAL(12,2)), ts, event_id, 0
  FROM events WHERE event_type = 'purchase' AND event_id + 1 NOT IN (SELECT event_id FROM events WHERE {VIEW} 3)),
tog AS (SELECT {K_SQL} AS product_id, count(*) AS n FROM events
        WHERE event_type = 'error' AND {K_SQL} IN (SELECT product_id FROM products) GROUP BY 1),
promotions AS (
  SELECT p.product_id, p.promotion_discount,
         CASE WHEN t.n % 2 = 1 THEN NOT p.active ELSE p.active END AS active, p.start_date
  FROM promotions0 p LEFT JOIN tog t ON p.product_id = t.product_id
  UNION ALL
  SELECT t.product_id, CAST(10.00 AS DECIMAL(10,2)), t.n % 2 = 1, NULL
  FROM tog t WHERE t.product_id NOT IN (SELECT product_id FROM promotions0)),
adds AS (SELECT p.product_id, p.product_name, p.category_id, p.base_price AS price, date_trunc('hour', e.ts) AS ts, event_id
         FROM events e JOIN products0 p ON p.product_id = {K_SQL} WHERE event_type = 'signup'),
cuts AS (SELECT date_trunc('hour', ts) AS ts, max(event_id) AS cut FROM events WHERE {VIEW} 1 GROUP BY 1),
shopping_cart AS (
  SELECT * FROM shopping_cart0 WHERE ts NOT IN (SELECT ts FROM cuts)
  UNION ALL
  SELECT product_id, product_name, category_id, price, ts FROM adds LEFT JOIN cuts USING (ts) WHERE cut IS NULL OR event_id > cut),
deltas AS (SELECT product_id, fixed, delta, row_number() OVER (PARTITION BY product_id ORDER BY event_id) AS step
           FROM (SELECT {K_SQL} AS product_id, NULL AS fixed, CAST(event_id % 11 - 5 AS INTEGER) AS delta, event_id FROM events WHERE event_type = 'click'
                 UNION ALL SELECT product_id, CAST(5 + (event_id * 7 + 3) % 21 AS INTEGER), 0, event_id FROM adds)),
inv_rows AS (SELECT row_number() OVER () AS row_id, product_id, warehouse_id, stock FROM
              (SELECT product_id, warehouse_id, stock FROM inventory0 UNION ALL
               SELECT DISTINCT product_id, 1, 0 FROM adds WHERE product_id NOT IN (SELECT product_id FROM inventory0))),
walk AS (
  WITH RECURSIVE w(row_id, product_id, step, stock) AS (
    SELECT row_id, product_id, 0, stock FROM inv_rows
    UNION ALL
    SELECT w.row_id, w.product_id, w.step + 1, coalesce(d.fixed, GREATEST(0, w.stock + d.delta))
    FROM w JOIN deltas d ON d.product_id = w.product_id AND d.step = w.step + 1)
  SELECT row_id, arg_max(stock, step) AS stock FROM w GROUP BY row_id),
inventory AS (
  SELECT i.product_id, CAST(w.stock AS INTEGER) AS stock, i.warehouse_id
  FROM inv_rows i JOIN walk w USING (row_id))
"""


def final_sql(*blocks: str, body: str) -> str:
    return "WITH " + ",".join([FINAL_STATE, *blocks]) + "\n" + body


def pricing_store(spark, sf_dir):
    m = model_for(spark, sf_dir)
    if "pricing_store" not in m.extra:
        m.extra["pricing_store"] = J.maintain_pricing(spark, sf_dir, m)
    return m.extra["pricing_store"]


@register("stream_pricing", final_sql(PRICING, body="SELECT product_id, adjusted_price, last_update_time FROM live_price"),
          ids="T2 IO6 T1")
def stream_pricing(spark, sf_dir):
    return pricing_store(spark, sf_dir).prices()


@register("stream_cart", final_sql(PRICING, CART, body="FROM basket_priced"), ids="T3")
def stream_cart(spark, sf_dir):
    return pricing_store(spark, sf_dir).cart_lines()


@register("stream_category_totals",
          final_sql(PRICING, CART, HIERARCHY,
                    body="SELECT category_id, parent_id, has_subcategory, category_name, "
                         "CAST(total AS DOUBLE) AS total, item_count FROM shown"),
          ids="T4")
def stream_category_totals(spark, sf_dir):
    return pricing_store(spark, sf_dir).category_totals()


@register("snapshot_read", final_sql(PRICING, CART, HIERARCHY, body="""
SELECT 1 AS version, coalesce(CAST(round((SELECT sum(CAST(price AS DECIMAL(20,10))) FROM basket_priced), 2) AS DOUBLE), 0) AS cart_total,
       coalesce(CAST(round((SELECT sum(total) FROM shown WHERE parent_id IS NULL), 2) AS DOUBLE), 0) AS categories_total"""), ids="T17")
def snapshot_read(spark, sf_dir):
    return J.pinned_cart_summary(pricing_store(spark, sf_dir))


def _frontier_sql(frontier: str) -> str:
    """Sums over the views after the events up to a frontier (the base cart keeps all events)."""
    state = final_sql(PRICING, CART, HIERARCHY, body="").replace("FROM events", "FROM feed").replace(
        "FROM feed e\n  JOIN products0 p", "FROM events e\n  JOIN products0 p")
    feed = f"WITH upto AS (SELECT {frontier} AS f FROM events), feed AS (SELECT * FROM events WHERE event_id <= (SELECT f FROM upto)),"
    return state.replace("WITH ", feed, 1) + """
SELECT (SELECT f FROM upto)::BIGINT AS frontier, (SELECT count(*) FROM live_price) AS products,
       (SELECT sum(CAST(round(adjusted_price * 1e6) AS BIGINT))::BIGINT FROM live_price) AS price_micros,
       (SELECT count(*) FROM basket_priced) AS lines, (SELECT coalesce(sum(available_stock), 0)::BIGINT FROM basket_priced) AS line_stock,
       (SELECT coalesce(sum(CAST(round(price * 1e6) AS BIGINT)), 0)::BIGINT FROM basket_priced) AS line_micros,
       (SELECT count(*) FROM shown) AS categories, (SELECT coalesce(sum(item_count), 0)::BIGINT FROM shown) AS category_items"""


@register("stream_changelog", "SELECT * FROM (" + _frontier_sql(
    "min(CASE WHEN event_id >= ((SELECT min(event_id) + max(event_id) FROM events) // 2) AND event_id % 3 = 1 THEN event_id END) - 1")
    + ")\nUNION ALL\nSELECT * FROM (" + _frontier_sql("max(event_id)") + ")", ids="T1 IO6 T2 T17")
def stream_changelog(spark, sf_dir):
    return J.frontier_summary(J.replay_changelog(spark, sf_dir, model_for(spark, sf_dir)))


@register("stream_replica", """
WITH c AS (SELECT user_id AS key, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS op,
                  event_id AS seq, event_type, value FROM events),
l AS (SELECT key, arg_max(op, seq) AS op, max(seq) AS seq, arg_max(event_type, seq) AS event_type,
             arg_max(value, seq) AS value FROM c GROUP BY key)
SELECT key, seq, event_type, value FROM l WHERE op <> 'D'""", ids="T1 IO6")
def stream_replica(spark, sf_dir):
    return J.maintain_replica(spark, sf_dir).read("replica")


@register("stream_rate", """
SELECT event_type AS source, time_bucket(INTERVAL 1 hour, ts) AS window_start, count(*) AS events
FROM events GROUP BY 1, 2""", ids="T10")
def stream_rate(spark, sf_dir):
    return J.maintain_rate(spark, sf_dir).read("rate")


@register("stream_trailing_rate", TRAILING_SQL, ids="T10 W6")
def stream_trailing_rate(spark, sf_dir):
    return J.maintain_trailing_rate(spark, sf_dir).read()


@register("cached_refresh", "WITH " + ",".join([MODEL, PRICING]) + "\nSELECT product_id, adjusted_price, last_update_time FROM live_price",
          ids="T5 IO7 T6")
def cached_refresh(spark, sf_dir):
    m = model_for(spark, sf_dir)
    store = J.refresh_cached_pricing(spark, m)
    return store.read("prices")


# --- E1: the priced point read in the two stored modes ----------------------------------------

@register("point_read_cached", "WITH " + ",".join([MODEL, PRICING])
          + "\nSELECT product_id, adjusted_price, last_update_time FROM live_price WHERE product_id = 1", ids="P8 T5 T17")
def point_read_cached(spark, sf_dir):
    """The point lookup served from the newest committed batch refresh."""
    m = model_for(spark, sf_dir)
    if "cached_store" not in m.extra:
        m.extra["cached_store"] = J.refresh_cached_pricing(spark, m)
    return m.extra["cached_store"].read("prices").where(F.col("product_id") == 1)


@register("point_read_incremental", final_sql(PRICING, body="SELECT product_id, adjusted_price, last_update_time FROM live_price WHERE product_id = 1"),
          ids="P8 T2 T17")
def point_read_incremental(spark, sf_dir):
    """The point lookup served from the newest committed incremental version."""
    return pricing_store(spark, sf_dir).prices().where(F.col("product_id") == 1)
