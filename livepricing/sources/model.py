"""The pricing data model as a bundle of DataFrames.

Money is held as exact integers: ``base_price``, ``price``, ``sale_price`` (and cart
``price``) in cents, ``promotion_discount`` in hundredths of a percent. Sums stay exact
and stay in whole-stage codegen (a DECIMAL cast from DOUBLE costs about a microsecond a
row on the JVM); ``functions.money`` turns them back into the values NUMERIC(10,2)
arithmetic gives.

``Model`` carries the tables the views read (products, sales, promotions, inventory,
categories, shopping_cart) plus two knobs: the total tie-break order for "most recent
sales" and the name keyword that triggers the extra discount. It can be built from the
driver's TPC-H-style tables (``from_driver_tables``) or from reference-style CSV exports
(``sources.ingest.load_csv_model``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
REFERENCE_DISCOUNT_KEYWORD = "cheap"   # name keyword of the 20 % discount
RECENT_SALES = 10                      # sales averaged for the recent price
RANK_TOP = 3                           # best band of the rank multipliers
RANK_NEAR = 10                         # second band of the rank multipliers

# Keyword used with the driver tables, whose part names never contain the reference's.
DRIVER_DISCOUNT_KEYWORD = "small"

DRIVER_TABLES = ("region", "nation", "supplier", "part", "lineitem", "orders",
                 "customer", "events")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass
class Model:
    products: DataFrame
    sales: DataFrame
    promotions: DataFrame
    inventory: DataFrame
    categories: DataFrame
    shopping_cart: DataFrame
    # descending sort keys after sale_date that make "the 10 most recent sales" total
    sale_tiebreak: tuple[str, ...] = ("sale_id",)
    discount_keyword: str = REFERENCE_DISCOUNT_KEYWORD
    extra: dict = field(default_factory=dict)

    def with_tables(self, **tables: DataFrame) -> "Model":
        return replace(self, **tables)

    def sale_order(self) -> list[Column]:
        return [F.col("sale_date").desc()] + [F.col(c).desc() for c in self.sale_tiebreak]

    def sale_order_sql(self) -> str:
        """The same order as SQL text: newest first, then the tie-breaks descending."""
        return ", ".join(f"`{c}` DESC" for c in ("sale_date", *self.sale_tiebreak))


def cents(col) -> "F.Column":
    """A DOUBLE holding a 2-decimal amount -> exact integer hundredths."""
    return F.round(col * 100).cast("bigint")


def driver_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> products. Every 10th part sits directly on a nation (an internal category),
    the rest on a supplier-level leaf category."""
    part = read_table(spark, sf_dir, "part")
    # one scalar for the whole model (a metadata-sized job), used as a literal below
    n_supp = read_table(spark, sf_dir, "supplier").count()
    key = F.col("p_partkey")
    category = (F.when(key % 10 == 0, F.lit(101) + key % 25)
                .otherwise(F.lit(10001) + key % F.lit(n_supp))).cast("bigint")
    return part.select(key.alias("product_id"),
                       F.col("p_name").alias("product_name"),
                       cents(F.col("p_retailprice")).alias("base_price"),
                       category.alias("category_id"),
                       (key % F.lit(n_supp)).cast("bigint").alias("supplier_id"),
                       F.lit(True).alias("available"),
                       F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("last_update_time"))


def driver_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    price = cents(F.col("l_extendedprice"))
    disc = cents(F.col("l_discount"))   # percent
    # round(price * (1 - d/100), 2) half-up, in integer cents
    sale = F.expr("div(price_c * (100 - disc_c) + 50, 100)")
    return (li.select(F.col("l_partkey").alias("product_id"), price.alias("price_c"),
                      disc.alias("disc_c"), F.col("l_shipdate").alias("sale_date"),
                      F.col("l_orderkey").alias("order_key"),
                      F.col("l_linenumber").alias("line_no"))
            .select("product_id", F.col("price_c").alias("price"), sale.alias("sale_price"),
                    "sale_date", "order_key", "line_no"))


def driver_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return (li.where((F.col("l_discount") > 0) & (F.col("l_linestatus") == "O"))
            .select(F.col("l_partkey").alias("product_id"),
                    # percent with 2 decimals, in hundredths of a percent
                    F.round(F.col("l_discount") * 10000).cast("bigint").alias("promotion_discount"),
                    (F.col("l_returnflag") == "N").alias("active"),
                    F.col("l_shipdate").alias("start_date")))


def driver_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return (li.where(F.col("l_returnflag") == "R")
            .select(F.col("l_partkey").alias("product_id"),
                    F.col("l_quantity").cast("int").alias("stock"),
                    F.col("l_suppkey").alias("warehouse_id")))


def driver_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region (roots) -> nation -> supplier: a 3-level category tree."""
    region = read_table(spark, sf_dir, "region")
    nation = read_table(spark, sf_dir, "nation")
    supplier = read_table(spark, sf_dir, "supplier")
    cols = ["category_id", "category_name", "parent_id"]
    roots = region.select((F.col("r_regionkey") + 1).cast("bigint"), F.col("r_name"),
                          F.lit(None).cast("bigint")).toDF(*cols)
    mids = nation.select((F.col("n_nationkey") + 101).cast("bigint"), F.col("n_name"),
                         (F.col("n_regionkey") + 1).cast("bigint")).toDF(*cols)
    leaves = supplier.select((F.col("s_suppkey") + 10001).cast("bigint"), F.col("s_name"),
                             (F.col("s_nationkey") + 101).cast("bigint")).toDF(*cols)
    return roots.unionByName(mids).unionByName(leaves)


def driver_cart(spark: SparkSession, sf_dir: str, products: DataFrame) -> DataFrame:
    """Purchase events -> cart lines copied from products (as a cart add does)."""
    ev = read_table(spark, sf_dir, "events")
    picked = (ev.where(F.col("event_type") == "purchase")
              .select(F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("product_id"),
                      F.col("ts")))
    return (picked.join(products.select("product_id", "product_name", "category_id",
                                        "base_price"), "product_id")
            .select("product_id", "product_name", "category_id",
                    F.col("base_price").alias("price"), "ts"))


def from_driver_tables(spark: SparkSession, sf_dir: str,
                       discount_keyword: str = DRIVER_DISCOUNT_KEYWORD) -> Model:
    products = driver_products(spark, sf_dir)
    return Model(
        products=products,
        sales=driver_sales(spark, sf_dir),
        promotions=driver_promotions(spark, sf_dir),
        inventory=driver_inventory(spark, sf_dir),
        categories=driver_categories(spark, sf_dir),
        shopping_cart=driver_cart(spark, sf_dir, products),
        sale_tiebreak=("order_key", "line_no", "price"),
        discount_keyword=discount_keyword,
        extra={"sf_dir": sf_dir},
    )


def driver_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> metric samples: one source per event type, value as latency seconds."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("source"), F.col("ts"),
                     F.col("value").alias("latency"), F.col("event_id").alias("seq"),
                     F.col("user_id"))
