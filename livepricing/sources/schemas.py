"""StructTypes of the pricing data model (one per table)."""

from pyspark.sql import types as T

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("base_price", T.DecimalType(10, 2)),
    T.StructField("category_id", T.LongType()),
    T.StructField("supplier_id", T.LongType()),
    T.StructField("available", T.BooleanType()),
    T.StructField("last_update_time", T.TimestampType()),
])

CATEGORIES = T.StructType([
    T.StructField("category_id", T.LongType()),
    T.StructField("category_name", T.StringType()),
    T.StructField("parent_id", T.LongType()),
])

SUPPLIERS = T.StructType([
    T.StructField("supplier_id", T.LongType()),
    T.StructField("supplier_name", T.StringType()),
])

# physical column order matters for headered chunk loads without a column list
SALES = T.StructType([
    T.StructField("sale_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("sale_price", T.DecimalType(10, 2)),
    T.StructField("sale_date", T.TimestampNTZType()),
    T.StructField("price", T.DecimalType(10, 2)),
])

INVENTORY = T.StructType([
    T.StructField("inventory_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("stock", T.IntegerType()),
    T.StructField("warehouse_id", T.LongType()),
    T.StructField("restock_date", T.TimestampNTZType()),
])

PROMOTIONS = T.StructType([
    T.StructField("promotion_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("promotion_discount", T.DecimalType(10, 2)),
    T.StructField("start_date", T.TimestampNTZType()),
    T.StructField("end_date", T.TimestampNTZType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("updated_at", T.TimestampType()),
])

SHOPPING_CART = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category_id", T.LongType()),
    T.StructField("price", T.DecimalType(10, 2)),
    T.StructField("ts", T.TimestampNTZType()),
])

HEARTBEATS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
])

REFRESH_LOG = T.StructType([
    T.StructField("view_name", T.StringType()),
    T.StructField("last_refresh", T.TimestampType()),
    T.StructField("refresh_duration", T.DoubleType()),
])

# flat stream of measurements the metrics operators read
SAMPLES = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("latency", T.DoubleType()),
])

# one change record of the replicated tables
CHANGES = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("op", T.StringType()),      # I / U / D
    T.StructField("seq", T.LongType()),
    T.StructField("key", T.LongType()),
])
