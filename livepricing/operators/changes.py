"""Change events applied to the model tables as set operations.

Every function takes the current table(s) and a DataFrame of events and returns the new
table (or the delta). A batch may hold many events for the same key; they are applied in
``seq`` order exactly as a sequence of single-row transactions would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .ranking import full_rank, top_k_per_group

# Fixed values that must equal the reference's for the same results.
NEW_PROMOTION_DISCOUNT = 1000        # 10.00 % in hundredths of a percent
NEW_PROMOTION_DAYS = 30
RESTOCK_DAYS = 30
NEW_STOCK_MIN, NEW_STOCK_MAX = 5, 25  # restock draw, inclusive
NEW_WAREHOUSE = 1
HEARTBEAT_PRODUCT = 1

DELTA_BUCKET = 1 << 20                # stock deltas composed per seq range of this width


# --- IO7 / IO8 ----------------------------------------------------------------------------

def upsert(current: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """IO7 (INSERT ... ON CONFLICT DO UPDATE): the newest update per key replaces the row."""
    if order is not None:   # bounded: one row per key per map partition moves
        updates = top_k_per_group(updates, [key], [F.col(order).desc()], 1).drop("_rn")
    return current.join(updates.select(key), key, "left_anti").unionByName(updates)


def insert_ignore(current: DataFrame, new_rows: DataFrame, key: str,
                  order: str | None = None) -> DataFrame:
    """IO8 (INSERT ... ON CONFLICT DO NOTHING): only rows with an unseen key are added. When
    the batch itself repeats a key, the first row in ``order`` wins (as the first insert would);
    ties, and rows without an order, go to the least row by its columns from left to right."""
    fresh = new_rows.join(current.select(key), key, "left_anti")
    by = [order] if order is not None else []
    by += [c for c in new_rows.columns if c not in (key, order)]
    # bounded: one row per key per map partition moves
    fresh = top_k_per_group(fresh, [key], [F.col(c).asc() for c in by or [key]], 1).drop("_rn")
    return current.unionByName(fresh)


def next_ids(rows: DataFrame, existing: DataFrame, id_col: str, seq: str, out: str) -> DataFrame:
    """A12 + sequence: COALESCE(MAX(id), 0) + position of each new row in seq order. The
    position is a distributed rank, not a single-partition row_number; the rank reads its input
    several times, so the rows are written once."""
    rows = stage_table(rows, "new-rows")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()   # scalar subquery
    ranked = full_rank(rows.withColumn("_neg_seq", -F.col(seq)), [], "_neg_seq", "_pos")
    return (ranked.withColumn(out, (top + F.col("_pos")).cast("bigint"))
            .drop("_neg_seq", "_pos"))


def draw_stock(seq: Column) -> Column:
    """Reproducible stand-in for floor(random() * 21 + 5): a value in 5..25 from seq."""
    span = NEW_STOCK_MAX - NEW_STOCK_MIN + 1
    return (F.lit(NEW_STOCK_MIN) + F.pmod(seq * 7 + 3, F.lit(span))).cast("int")


def restock_date(as_of: Column) -> Column:
    return as_of + F.expr(f"INTERVAL {RESTOCK_DAYS} DAYS")


# --- T11 promotion toggles ---------------------------------------------------------------

def toggle_promotions(promotions: DataFrame, products: DataFrame, toggles: DataFrame,
                      now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each toggle flips ``active`` on every promotion row of the product; a product
    without promotions first gets a new active 10 % promotion for 30 days. An odd number of
    toggles in a batch flips, an even number leaves the state. Unknown products yield an
    error status and change nothing.

    ``now``: one row with column ``as_of`` (the time of the toggles: the start of inserted
    promotions, and ``updated_at`` of toggled rows where promotions have that column).
    Returns (new promotions, status per toggled product with updated_at and the resulting
    active flag: whether any of its promotions is active now)."""
    per = toggles.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    known = per.join(products.select("product_id"), "product_id", "left_semi")
    has_rows = promotions.select("product_id").distinct()
    flip = F.col("_n") % 2 == 1
    as_of = now.select("as_of").scalar()               # scalar subquery
    updated = (promotions.join(known, "product_id", "left")
               .withColumn("active", F.when(F.col("_n").isNotNull() & flip, ~F.col("active"))
                           .otherwise(F.col("active"))))
    if "updated_at" in promotions.columns:
        updated = updated.withColumn("updated_at", F.when(F.col("_n").isNotNull(), as_of)
                                     .otherwise(F.col("updated_at")))
    updated = updated.drop("_n")
    inserted = (known.join(has_rows, "product_id", "left_anti")
                .select("product_id",
                        F.lit(NEW_PROMOTION_DISCOUNT).cast("bigint").alias("promotion_discount"),
                        flip.alias("active"),    # the insert is active, later toggles flip it
                        as_of.alias("start_date"),
                        (as_of + F.expr(f"INTERVAL {NEW_PROMOTION_DAYS} DAYS")).alias("end_date"),
                        as_of.alias("updated_at")))
    cols = promotions.columns
    new = updated.unionByName(inserted.select(*[c for c in inserted.columns if c in cols]),
                              allowMissingColumns=True).select(*cols)
    # one row per toggled product: every known one has a promotion by now
    after = (new.join(known.select("product_id"), "product_id", "left_semi")
             .groupBy("product_id").agg(F.bool_or("active").alias("active")))
    done = F.col("active").isNotNull()
    status = (per.join(after, "product_id", "left")
              .select("product_id", F.when(done, F.lit("success")).otherwise(F.lit("error")).alias("status"),
                      "_n", F.when(done, as_of).alias("updated_at"), "active"))
    return new, status


# --- T12 new products --------------------------------------------------------------------

def add_products(products: DataFrame, new: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """New products (product_name, category_id, price cents, seq) get ids after the
    current maximum and fan out to a products, sales, inventory and cart delta."""
    rows = next_ids(new, products, "product_id", "seq", "product_id")
    prod = rows.select("product_id", "product_name", "category_id",
                       F.col("price").alias("base_price"),
                       F.lit(NEW_WAREHOUSE).cast("bigint").alias("supplier_id"),
                       F.lit(True).alias("available"), as_of.alias("last_update_time"))
    sales = rows.select("product_id", F.col("price").alias("price"), F.col("price").alias("sale_price"),
                        as_of.alias("sale_date"))
    inv = rows.select("product_id", F.lit(NEW_WAREHOUSE).cast("bigint").alias("warehouse_id"),
                      draw_stock(F.col("seq")).alias("stock"), restock_date(as_of).alias("restock_date"))
    cart = rows.select("product_id", "product_name", "category_id", "price", as_of.alias("ts"))
    return {"products": prod, "sales": sales, "inventory": inv, "shopping_cart": cart}


# --- T13 / T14 cart events ---------------------------------------------------------------

def cart_add(cart: DataFrame, products: DataFrame, inventory: DataFrame,
             adds: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Append cart rows copied from products and restock every added product: all its
    inventory rows get the new stock, a product without inventory gets a new row; where the
    inventory has a ``restock_date``, these get the one 30 days after ``as_of``.
    ``adds``: (product_id, ts, seq). Returns (new cart, new inventory)."""
    lines = (adds.join(products.select("product_id", "product_name", "category_id", "base_price"),
                       "product_id")
             .select("product_id", "product_name", "category_id", F.col("base_price").alias("price"), "ts"))
    new_cart = cart.unionByName(lines.select(*cart.columns))
    # the last add of a product decides its stock
    restock = (adds.join(products.select("product_id"), "product_id", "left_semi")
               .groupBy("product_id").agg(F.max("seq").alias("_seq"))
               .select("product_id", draw_stock(F.col("_seq")).alias("_stock")))
    updated = (inventory.join(restock, "product_id", "left")
               .withColumn("stock", F.coalesce(F.col("_stock"), F.col("stock"))))
    dated = "restock_date" in inventory.columns
    if dated:
        updated = updated.withColumn("restock_date", F.when(F.col("_stock").isNotNull(), restock_date(as_of))
                                     .otherwise(F.col("restock_date")))
    updated = updated.drop("_stock")
    created = (restock.join(inventory.select("product_id"), "product_id", "left_anti")
               .select("product_id", F.lit(NEW_WAREHOUSE).cast("bigint").alias("warehouse_id"),
                       F.col("_stock").alias("stock"),
                       *([restock_date(as_of).alias("restock_date")] if dated else [])))
    new_inv = updated.unionByName(created, allowMissingColumns=True).select(*inventory.columns)
    return new_cart, new_inv


def cart_delete(cart: DataFrame, delete_ts: DataFrame) -> DataFrame:
    """DELETE ... WHERE ts IN (...): every cart row sharing a listed ts goes."""
    return cart.join(delete_ts.select("ts").distinct(), "ts", "left_anti").select(*cart.columns)


def seeded_pick(rows: DataFrame, key: str, seed: int, n: int = 1) -> DataFrame:
    """ORDER BY RANDOM() LIMIT n, made repeatable: the rows first by md5 of key and seed."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.orderBy(draw, key).limit(n)


# --- T15 stock deltas --------------------------------------------------------------------
#
# One step is s -> max(0, s + d). Any run of steps is s -> max(a, s + b), and running
# (a1, b1) then (a2, b2) is (max(a2, a1 + b2), b1 + b2): an associative composition. A
# run of deltas d_1..d_n has b = sum(d) and a = sum(d) - min(prefix sums). So the
# ordered fold is split into seq ranges, each composed with a window bounded by its range,
# and the ranges are composed in order over one summary row per range.

def delta_composition(deltas: DataFrame, bucket_width: int = DELTA_BUCKET) -> DataFrame:
    """Per product: (a, b) of all its deltas composed in seq order."""
    d = deltas.withColumn("_bk", F.floor(F.col("seq") / F.lit(bucket_width)))
    w = Window.partitionBy("product_id", "_bk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    prefix = d.withColumn("_p", F.sum("delta").over(w))
    per_bucket = prefix.groupBy("product_id", "_bk").agg(
        F.sum("delta").alias("_b"), F.min("_p").alias("_minp"))
    per_bucket = per_bucket.withColumn("_a", F.col("_b") - F.col("_minp"))
    # compose buckets in order: a = max over buckets k of (a_k + sum of later b)
    wl = Window.partitionBy("product_id").orderBy("_bk").rowsBetween(1, Window.unboundedFollowing)
    later = per_bucket.withColumn("_later_b", F.coalesce(F.sum("_b").over(wl), F.lit(0)))
    return later.groupBy("product_id").agg(
        F.max(F.col("_a") + F.col("_later_b")).alias("a"), F.sum("_b").alias("b"))


def apply_stock_deltas(inventory: DataFrame, deltas: DataFrame,
                       bucket_width: int = DELTA_BUCKET) -> DataFrame:
    """UPDATE inventory SET stock = GREATEST(0, stock + d) WHERE product_id = p, for each
    delta (product_id, seq, delta) in seq order, on every inventory row of the product."""
    comp = delta_composition(deltas, bucket_width)
    return (inventory.join(comp, "product_id", "left")
            .withColumn("stock", F.when(F.col("a").isNull(), F.col("stock"))
                        .otherwise(F.greatest(F.col("a"), F.col("stock") + F.col("b"))).cast("int"))
            .drop("a", "b"))


# --- T16 heartbeats ----------------------------------------------------------------------

def apply_heartbeats(heartbeats: DataFrame, products: DataFrame,
                     beats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append the beats (id, ts) and touch product 1's last_update_time with the newest
    beat, as one unit (both outputs derive from the same input batch)."""
    new_hb = heartbeats.unionByName(beats.select(*heartbeats.columns))
    beat = beats.agg(F.max("ts")).scalar()             # scalar subquery
    touched = products.withColumn(
        "last_update_time",
        F.when((F.col("product_id") == HEARTBEAT_PRODUCT) & beat.isNotNull(), beat)
        .otherwise(F.col("last_update_time")))
    return new_hb, touched
