"""Registered ingestion and change-event queries. Event batches are
derived from the events table: product key = props.k, seq = event id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import money, percent
from ..operators import changes as CH
from ..session import scratch_path
from ..sources import ingest as IN
from ..sources import schemas as S
from ..sources.model import cents, read_table
from .oracle import with_model
from .registry import model_for, on_model, register

K = "try_cast(get_json_object(props, '$.k') AS BIGINT)"
K_SQL = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"


def events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


def as_of(spark, sf_dir):
    return events(spark, sf_dir).agg(F.max("ts").alias("as_of"))


# --- IO3 / IO5 ------------------------------------------------------------------------------

@register("dedup_latest", """
WITH raw AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_retailprice AS base_price,
         TIMESTAMP '2024-01-01 00:00:00' AS last_update_time FROM part
  UNION ALL
  SELECT p_partkey, p_name || ' v2', p_retailprice + 1, TIMESTAMP '2024-02-01 00:00:00'
  FROM part WHERE p_partkey % 3 = 0)
SELECT DISTINCT ON (product_id) product_id, product_name, base_price, last_update_time
FROM raw ORDER BY product_id, last_update_time DESC""", ids="IO3")
def dedup_latest(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    old = part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
                      F.col("p_retailprice").alias("base_price"),
                      F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("last_update_time"))
    new = part.where(F.col("p_partkey") % 3 == 0).select(
        "p_partkey", F.concat("p_name", F.lit(" v2")), F.col("p_retailprice") + 1,
        F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).toDF(*old.columns)
    return IN.dedup_latest(old.unionByName(new))


@register("load_correction", with_model(body="""
SELECT product_id,
       CASE WHEN product_id = 1 THEN 'Fresh Red Delicious Apple' ELSE product_name END AS product_name,
       CASE WHEN product_id = 1 THEN CAST(0.75 AS DOUBLE) ELSE CAST(base_price AS DOUBLE) END AS base_price
FROM products"""), ids="IO5")
@on_model
def load_correction(m):
    p = IN.apply_correction(m.products, "retail")
    return p.select("product_id", "product_name", money(F.col("base_price")).alias("base_price"))


# --- IO10-IO13 reduced dataset ---------------------------------------------------------------

REDUCED_SQL = """, kept AS (
  SELECT product_id FROM products WHERE product_id = 1
  UNION ALL
  SELECT product_id FROM (SELECT product_id, row_number() OVER (ORDER BY product_id) AS rn
                          FROM products WHERE product_id <> 1) t WHERE rn % 2 = 1)"""


@register("reduced_products", with_model(body=REDUCED_SQL + "\nSELECT product_id FROM kept"), ids="IO10")
@on_model
def reduced_products(m):
    return IN.half_products(m.products).select("product_id")


@register("reduced_inventory", with_model(body=REDUCED_SQL + """
SELECT product_id, warehouse_id, CAST((stock + 1) // 2 AS INTEGER) AS stock
FROM inventory WHERE product_id IN (SELECT product_id FROM kept)"""), ids="IO11 IO12")
@on_model
def reduced_inventory(m):
    r = IN.reduce_model(m, sale_id="order_key")
    return r.inventory.select("product_id", "warehouse_id", "stock")


@register("reduced_sales", with_model(body=REDUCED_SQL + """
SELECT product_id, order_key, line_no, CAST(price AS DOUBLE) AS price
FROM sales WHERE product_id IN (SELECT product_id FROM kept) AND (product_id = 1 OR order_key % 2 = 0)"""),
          ids="IO11 IO13")
@on_model
def reduced_sales(m):
    r = IN.reduce_model(m, sale_id="order_key")
    return r.sales.select("product_id", "order_key", "line_no", money(F.col("price")).alias("price"))


@register("orphan_check", with_model(body="""
SELECT 'sales' AS "table", count(*) AS orphans FROM sales WHERE product_id NOT IN (SELECT product_id FROM products)
UNION ALL
SELECT 'promotions', count(*) FROM promotions WHERE product_id NOT IN (SELECT product_id FROM products)
UNION ALL
SELECT 'inventory', count(*) FROM inventory WHERE product_id NOT IN (SELECT product_id FROM products)"""),
          ids="J12 IO11")
@on_model
def orphan_check(m):
    return IN.orphan_counts(m)


# --- IO7 / IO8 -----------------------------------------------------------------------------

# one view per event type and user; events before the cut made the log, the others update it
LOG_CUT = "2024-01-16 00:00:00"


def _log(ev):
    view = F.concat_ws("_", F.lit("mv"), "event_type", "user_id")
    return (ev.groupBy(view.alias("view_name"))
            .agg(F.max("ts").alias("last_refresh"),
                 (F.max_by("value", F.struct("ts", "event_id")) / 1000.0).alias("refresh_duration")))


@register("upsert_log", f"""
WITH e AS (SELECT concat_ws('_', 'mv', event_type, user_id) AS view_name, ts, event_id, value,
                  ts >= TIMESTAMP '{LOG_CUT}' AS late FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY view_name ORDER BY late DESC, ts DESC, event_id DESC) AS r FROM e)
SELECT view_name, ts AS last_refresh, value / 1000.0 AS refresh_duration FROM ranked WHERE r = 1""", ids="IO7")
def upsert_log(spark, sf_dir):
    ev = events(spark, sf_dir)
    late = F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{LOG_CUT}'")
    return CH.upsert(_log(ev.where(~late)), _log(ev.where(late)), "view_name", order="last_refresh")


@register("insert_ignore", with_model(body="""
SELECT product_id, product_name FROM products WHERE product_id % 2 = 0
UNION ALL
SELECT product_id, product_name || ' new' FROM products WHERE product_id % 2 <> 0"""), ids="IO8")
@on_model
def insert_ignore(m):
    cur = m.products.where(F.col("product_id") % 2 == 0).select("product_id", "product_name")
    new = m.products.select("product_id", F.concat("product_name", F.lit(" new")).alias("product_name"))
    return CH.insert_ignore(cur, new, "product_id")


# --- T11 toggles ----------------------------------------------------------------------------

def toggles(spark, sf_dir):
    ev = events(spark, sf_dir).where(F.col("event_type").isin("click", "error"))
    pid = F.when(F.col("event_type") == "click", F.expr(K)).otherwise(F.expr(K) + 900000)
    return ev.select(pid.alias("product_id"), F.col("event_id").alias("seq"), "ts")


TOGGLE_SQL = f"""
, t AS (SELECT CASE WHEN event_type = 'click' THEN {K_SQL} ELSE {K_SQL} + 900000 END AS product_id
        FROM events WHERE event_type IN ('click', 'error')),
per AS (SELECT product_id, count(*) AS n FROM t GROUP BY product_id),
known AS (SELECT * FROM per WHERE product_id IN (SELECT product_id FROM products)),
now AS (SELECT max(ts) AS as_of FROM events)"""


def dated_promotions(m):
    """Promotions with the dates a toggle writes: they run 30 days and were last touched at
    their start."""
    return (m.promotions.withColumn("end_date", F.col("start_date") + F.expr("INTERVAL 30 DAYS"))
            .withColumn("updated_at", F.col("start_date")))


TOGGLED_SQL = TOGGLE_SQL + """,
after AS (
SELECT p.product_id, CAST(p.promotion_discount AS DOUBLE) AS promotion_discount,
       (p.active <> (coalesce(k.n, 0) % 2 = 1)) AS active, p.start_date,
       p.start_date + INTERVAL 30 DAYS AS end_date,
       CASE WHEN k.n > 0 THEN as_of ELSE p.start_date END AS updated_at
FROM promotions p LEFT JOIN known k ON p.product_id = k.product_id, now
UNION ALL
SELECT k.product_id, CAST(10.0 AS DOUBLE), k.n % 2 = 1, now.as_of, now.as_of + INTERVAL 30 DAYS, now.as_of
FROM known k, now WHERE k.product_id NOT IN (SELECT product_id FROM promotions))"""


@register("toggle_promotion", with_model(body=TOGGLED_SQL + "\nSELECT * FROM after"),
          ids="T11 J11 J12 F11 F5")
def toggle_promotion(spark, sf_dir):
    m = model_for(spark, sf_dir)
    new, _ = CH.toggle_promotions(dated_promotions(m), m.products, toggles(spark, sf_dir), as_of(spark, sf_dir))
    return new.select("product_id", percent(F.col("promotion_discount")).alias("promotion_discount"),
                      "active", "start_date", "end_date", "updated_at")


@register("toggle_status", with_model(body=TOGGLED_SQL + """
SELECT per.product_id, CASE WHEN known.n > 0 THEN 'success' ELSE 'error' END AS status, per.n AS toggles,
       CASE WHEN known.n > 0 THEN as_of END AS updated_at,
       (SELECT max(active) FROM after WHERE after.product_id = known.product_id) AS active
FROM per LEFT JOIN known ON known.product_id = per.product_id, now"""), ids="T11")
def toggle_status(spark, sf_dir):
    m = model_for(spark, sf_dir)
    _, status = CH.toggle_promotions(dated_promotions(m), m.products, toggles(spark, sf_dir),
                                     as_of(spark, sf_dir))
    return status.withColumnRenamed("_n", "toggles")


# --- T12 new products -----------------------------------------------------------------------

@register("add_products", with_model(body="""
, now AS (SELECT max(ts) AS as_of FROM events)
SELECT (SELECT coalesce(max(product_id), 0) FROM products) + row_number() OVER (ORDER BY event_id)
         AS product_id,
       'New product ' || event_id AS product_name, CAST(101 + user_id % 25 AS BIGINT) AS category_id,
       value AS base_price, as_of AS last_update_time
FROM events, now WHERE event_type = 'signup'"""), ids="T12 A12")
def add_products(spark, sf_dir):
    return added(spark, sf_dir)["products"].select(
        "product_id", "product_name", "category_id", money(F.col("base_price")).alias("base_price"), "last_update_time")


def added(spark, sf_dir):
    m = model_for(spark, sf_dir)
    ev = events(spark, sf_dir).where(F.col("event_type") == "signup")
    new = ev.select(F.concat(F.lit("New product "), F.col("event_id").cast("string")).alias("product_name"),
                    (F.lit(101) + F.col("user_id") % 25).cast("bigint").alias("category_id"),
                    cents(F.col("value")).alias("price"), F.col("event_id").alias("seq"))
    return CH.add_products(m.products, new, as_of(spark, sf_dir).scalar())


ADDED_SQL = """, fresh AS (
  SELECT (SELECT coalesce(max(product_id), 0) FROM products) + 1
           + (SELECT count(*) FROM events earlier WHERE earlier.event_type = 'signup' AND earlier.event_id < e.event_id)
           AS product_id, e.*, (SELECT max(ts) FROM events) AS as_of
  FROM events e WHERE event_type = 'signup')
"""


@register("add_products_sales", with_model(body=ADDED_SQL + """
SELECT product_id, value AS price, value AS sale_price, as_of AS sale_date FROM fresh"""), ids="T12")
def add_products_sales(spark, sf_dir):
    return added(spark, sf_dir)["sales"].select("product_id", money(F.col("price")).alias("price"),
                                                money(F.col("sale_price")).alias("sale_price"), "sale_date")


@register("add_products_inventory", with_model(body=ADDED_SQL + """
SELECT product_id, CAST(1 AS BIGINT) AS warehouse_id, CAST(5 + (event_id * 7 + 3) % 21 AS INTEGER) AS stock,
       as_of + INTERVAL 30 DAYS AS restock_date FROM fresh"""), ids="T12 F4 F5")
def add_products_inventory(spark, sf_dir):
    return added(spark, sf_dir)["inventory"]


@register("add_products_cart", with_model(body=ADDED_SQL + """
SELECT product_id, 'New product ' || event_id AS product_name, CAST(101 + user_id % 25 AS BIGINT) AS category_id,
       value AS price, as_of AS ts FROM fresh"""), ids="T12")
def add_products_cart(spark, sf_dir):
    return added(spark, sf_dir)["shopping_cart"].withColumn("price", money(F.col("price")))


# --- T13 / T14 cart -------------------------------------------------------------------------

FIRST_RESTOCK = "2024-03-01 00:00:00"   # restock date of the inventory before the adds


@register("cart_add", with_model(body=f"""
, adds AS (SELECT {K_SQL} AS product_id, event_id AS seq FROM events WHERE event_type = 'view'),
restock AS (SELECT product_id, CAST(5 + (max(seq) * 7 + 3) % 21 AS INTEGER) AS s,
                   (SELECT max(ts) FROM events) + INTERVAL 30 DAYS AS due FROM adds
            WHERE product_id IN (SELECT product_id FROM products) GROUP BY product_id)
SELECT i.product_id, i.warehouse_id, COALESCE(r.s, i.stock) AS stock,
       COALESCE(r.due, TIMESTAMP '{FIRST_RESTOCK}') AS restock_date
FROM inventory i LEFT JOIN restock r ON i.product_id = r.product_id
UNION ALL
SELECT product_id, 1, s, due FROM restock WHERE product_id NOT IN (SELECT product_id FROM inventory)"""),
          ids="T13 J11 J12 F4")
def cart_add(spark, sf_dir):
    return _cart_added(spark, sf_dir)[1].select("product_id", "warehouse_id", "stock", "restock_date")


@register("cart_add_lines", with_model(body=f"""
SELECT product_id, product_name, category_id, CAST(price AS DOUBLE) AS price, ts FROM shopping_cart
UNION ALL
SELECT p.product_id, p.product_name, p.category_id, CAST(p.base_price AS DOUBLE), v.ts
FROM (SELECT {K_SQL} AS k, ts FROM events WHERE event_type = 'view') v, products p WHERE p.product_id = v.k"""), ids="T13")
def cart_add_lines(spark, sf_dir):
    return _cart_added(spark, sf_dir)[0].select("product_id", "product_name", "category_id",
                                                money(F.col("price")).alias("price"), "ts")


def _cart_added(spark, sf_dir):
    m = model_for(spark, sf_dir)
    adds = events(spark, sf_dir).where(F.col("event_type") == "view").select(
        F.expr(K).alias("product_id"), "ts", F.col("event_id").alias("seq"))
    inventory = m.inventory.withColumn("restock_date", F.expr(f"TIMESTAMP_NTZ '{FIRST_RESTOCK}'"))
    return CH.cart_add(m.shopping_cart, m.products, inventory, adds, as_of(spark, sf_dir).scalar())


PICK_SEED = 7


@register("random_product", with_model(body=f"""
SELECT product_id, product_name, category_id FROM products WHERE product_id <> 1
ORDER BY md5('{PICK_SEED}:' || product_id), product_id LIMIT 1"""), ids="O4")
@on_model
def random_product(m):
    """The product a cart add picks at random."""
    return CH.seeded_pick(m.products.where(F.col("product_id") != 1)
                          .select("product_id", "product_name", "category_id"), "product_id", PICK_SEED)


@register("cart_delete", with_model(body="""
SELECT product_id, product_name, category_id, CAST(price AS DOUBLE) AS price, ts FROM shopping_cart
WHERE ts NOT IN (SELECT ts FROM shopping_cart WHERE product_id % 7 = 3)"""), ids="T14 J10")
@on_model
def cart_delete(m):
    gone = m.shopping_cart.where(F.col("product_id") % 7 == 3).select("ts")
    out = CH.cart_delete(m.shopping_cart, gone)
    return out.select("product_id", "product_name", "category_id",
                      money(F.col("price")).alias("price"), "ts")


# --- T15 stock deltas -----------------------------------------------------------------------

def stock_delta_events(spark, sf_dir):
    ev = events(spark, sf_dir).where(F.col("event_type") == "click")
    return ev.select(F.expr(K).alias("product_id"), F.col("event_id").alias("seq"),
                     ((F.col("event_id") % 11) - 5).cast("int").alias("delta"))


@register("stock_deltas", with_model(body=f"""
, d AS (SELECT {K_SQL} AS product_id, CAST(event_id % 11 - 5 AS INTEGER) AS delta,
               row_number() OVER (PARTITION BY {K_SQL} ORDER BY event_id) AS step
        FROM events WHERE event_type = 'click'),
inv AS (SELECT row_number() OVER () AS row_id, product_id, warehouse_id, stock FROM inventory),
walk AS (
  WITH RECURSIVE w(row_id, product_id, step, stock) AS (
    SELECT row_id, product_id, 0, stock FROM inv
    UNION ALL
    SELECT w.row_id, w.product_id, w.step + 1, GREATEST(0, w.stock + d.delta)
    FROM w JOIN d ON d.product_id = w.product_id AND d.step = w.step + 1)
  SELECT row_id, arg_max(stock, step) AS stock FROM w GROUP BY row_id)
SELECT inv.product_id, inv.warehouse_id, CAST(walk.stock AS INTEGER) AS stock
FROM inv JOIN walk USING (row_id)"""), ids="T15 F3")
def stock_deltas(spark, sf_dir):
    m = model_for(spark, sf_dir)
    new = CH.apply_stock_deltas(m.inventory, stock_delta_events(spark, sf_dir))
    return new.select("product_id", "warehouse_id", "stock")


# --- T16 heartbeats -------------------------------------------------------------------------

@register("heartbeat_apply", with_model(body="""
, b AS (SELECT max(ts) AS beat FROM events WHERE event_type = 'view')
SELECT product_id, CASE WHEN product_id = 1 AND beat IS NOT NULL THEN beat ELSE last_update_time END
       AS last_update_time FROM products, b"""), ids="T16")
def heartbeat_apply(spark, sf_dir):
    m = model_for(spark, sf_dir)
    return _beaten(spark, sf_dir, m.products)[1].select("product_id", "last_update_time")


BEATS_FROM = "2024-01-16 00:00:00"   # earlier beats are in the table, later ones are applied


def _beaten(spark, sf_dir, products):
    beats = events(spark, sf_dir).where(F.col("event_type") == "view").select(F.col("event_id").alias("id"), "ts")
    new = F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{BEATS_FROM}'")
    return CH.apply_heartbeats(beats.where(~new), products, beats.where(new))


@register("heartbeat_append", "SELECT event_id AS id, ts FROM events WHERE event_type = 'view'", ids="T16")
def heartbeat_append(spark, sf_dir):
    return _beaten(spark, sf_dir, model_for(spark, sf_dir).products)[0]


# --- IO15 / IO1-IO2 (rows-only) ------------------------------------------------------

@register("table_size", None, ids="IO15")
def table_size(spark, sf_dir):
    return IN.table_size_gb(spark, sf_dir)


@register("load_csv", with_model(body="""
SELECT product_id, CAST(sale_price AS DECIMAL(10,2)) AS sale_price, sale_date,
       CAST(price AS DECIMAL(10,2)) AS price FROM sales"""), ids="IO1 IO2")
def load_csv(spark, sf_dir):
    """Round trip: the model's sales written as headered CSV chunks to the shared folder,
    then bulk-loaded back with the explicit sales schema (NUMERIC(10,2) money)."""
    m = model_for(spark, sf_dir)
    out = scratch_path(spark, "sales_chunks")
    (m.sales.select(F.monotonically_increasing_id().alias("sale_id"), "product_id",
                    money(F.col("sale_price")).alias("sale_price"), "sale_date",
                    money(F.col("price")).alias("price"))
     .write.option("header", True).csv(out))
    return IN.load_chunks(spark, out, S.SALES, pattern="part-*").drop("sale_id")
