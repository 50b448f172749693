"""Loading, cleaning, down-sampling and generating the model tables.

* CSV exports with a header and an explicit schema (empty field -> NULL, ``t``/``f``
  booleans), money converted once to exact integers (cents, hundredths of a percent).
* Directory-of-chunks loads appended to Parquet.
* Dedup on load (newest row per key), the post-load correction of product 1.
* The "reduced" dataset: half of the products (always keeping product 1), child tables
  filtered to the surviving keys, stock halved, sales thinned.
* A synthetic generator (``spark.range`` + hash-based draws, no driver loops) and a
  table-size metric that lists files without reading them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import full_rank, top_k_per_group
from ..session import stage_table
from . import schemas as S
from .model import Model

# Fixed values that must equal the reference's for the same results.
PRODUCT_ONE = 1
CORRECTIONS = {   # vertical -> (name, base price) of product 1 after the load
    "retail": ("Fresh Red Delicious Apple", 0.75),
    "finance": ("Apple", 175.25),
}
NAME_SUFFIXES = ("Premium", "Standard", "Basic", "Cheap", "Luxury")   # by i % 5
GEN_CATEGORIES, GEN_SUPPLIERS = 10, 5
GEN_PRICE_MIN, GEN_PRICE_SPAN = 50.0, 950.0
GEN_AVAILABLE_SHARE = 0.8
GEN_ACTIVE_PROMOTION_SHARE = 0.3
GEN_MAX_DISCOUNT = 50.0
GEN_SALES_DAYS, GEN_PROMO_DAYS = 365, 30
GEN_MAX_STOCK = 1000
GEN_WAREHOUSES_FROM = 2            # warehouses 2..6, round robin
GEN_WAREHOUSE_COUNT = 5


def money_cents(col: Column) -> Column:
    """NUMERIC(10,2) (or its text) -> exact integer cents."""
    return (col.cast("decimal(12,2)") * 100).cast("bigint")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO1: headered CSV read with an explicit column list (no inference)."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(as_text).option("header", True).option("mode", "FAILFAST").csv(path)
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            word = F.lower(F.trim(c))
            c = (F.when(word.isNull() | (word == ""), None)
                 .when(word.isin("t", "true", "1", "y", "yes", "on"), True)
                 .when(word.isin("f", "false", "0", "n", "no", "off"), False)
                 .otherwise(F.raise_error(F.concat(F.lit(f"{f.name} is no boolean: "), c)).cast("boolean")))
        else:
            c = F.when(F.trim(c) == "", None).otherwise(c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def _money_to_ints(df: DataFrame, cents_cols=(), hundredths_cols=()) -> DataFrame:
    out = df
    for c in cents_cols:
        out = out.withColumn(c, money_cents(F.col(c)))
    for c in hundredths_cols:
        out = out.withColumn(c, money_cents(F.col(c)))   # percent with 2 decimals
    return out


def load_chunks(spark: SparkSession, chunk_dir: str, schema: T.StructType,
                pattern: str = "chunk_*") -> DataFrame:
    """IO2: every chunk file of a directory in one distributed read."""
    return read_csv(spark, f"{chunk_dir.rstrip('/')}/{pattern}", schema)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def dedup_latest(df: DataFrame, key: str = "product_id", ts: str = "last_update_time",
                 tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """IO3: the newest row per key (DISTINCT ON ... ORDER BY key, ts DESC). A partial
    group limit keeps a hot key to one row per map partition before the shuffle."""
    order = [F.col(ts).desc_nulls_last()] + [F.col(c).desc_nulls_last() for c in tiebreak]
    return top_k_per_group(df, [key], order, 1).drop("_rn")


def apply_correction(products: DataFrame, dataset: str) -> DataFrame:
    """IO5: the post-load rename/reprice of product 1 for a dataset."""
    if dataset not in CORRECTIONS:
        return products
    name, price = CORRECTIONS[dataset]
    one = F.col("product_id") == PRODUCT_ONE
    return (products
            .withColumn("product_name", F.when(one, F.lit(name)).otherwise(F.col("product_name")))
            .withColumn("base_price", F.when(one, F.lit(int(round(price * 100)))).otherwise(
                F.col("base_price")).cast("bigint")))


def load_csv_model(spark: SparkSession, folder: str, dataset: str | None = None,
                   sales_chunks: str | None = None) -> Model:
    """IO1-IO5: a whole reference-style export folder as a Model."""
    f = folder.rstrip("/")
    categories = read_csv(spark, f"{f}/categories.csv", S.CATEGORIES)
    products = dedup_latest(_money_to_ints(read_csv(spark, f"{f}/products.csv", S.PRODUCTS),
                                           cents_cols=("base_price",)),
                            tiebreak=("base_price", "product_name", "category_id"))
    if dataset:
        products = apply_correction(products, dataset)
    sales_src = load_chunks(spark, sales_chunks, S.SALES) if sales_chunks else \
        read_csv(spark, f"{f}/sales.csv", S.SALES)
    sales = _money_to_ints(sales_src, cents_cols=("price", "sale_price"))
    promotions = _money_to_ints(read_csv(spark, f"{f}/promotions.csv", S.PROMOTIONS),
                                hundredths_cols=("promotion_discount",))
    inventory = read_csv(spark, f"{f}/inventory.csv", S.INVENTORY)
    cart = spark.createDataFrame([], S.SHOPPING_CART).withColumn("price", F.col("price").cast("bigint"))
    return Model(products=products, sales=sales, promotions=promotions, inventory=inventory,
                 categories=categories, shopping_cart=cart, sale_tiebreak=("sale_id",))


# --- reduced dataset (IO10-IO13) ---------------------------------------------------------

def half_products(products: DataFrame) -> DataFrame:
    """IO10: product 1 plus every other remaining product in key order (1st, 3rd, ...).
    The position comes from a distributed rank, not a single-partition row_number."""
    # the rank reads its input several times: rank the (written once) key column only
    keys = stage_table(products.where(F.col("product_id") != PRODUCT_ONE)
                       .select((-F.col("product_id")).alias("_neg")), "product-keys")
    positions = full_rank(keys, [], "_neg", "_pos")
    rest = products.where(F.col("product_id") != PRODUCT_ONE).withColumn("_neg", -F.col("product_id"))
    ranked = rest.join(positions, "_neg")
    kept = ranked.where(F.col("_pos") % 2 == 1).drop("_neg", "_pos")
    return products.where(F.col("product_id") == PRODUCT_ONE).unionByName(kept)


def keep_referenced(child: DataFrame, parents: DataFrame, key: str = "product_id") -> DataFrame:
    """IO11: child rows whose key survives (a semi-join)."""
    return child.join(parents.select(key), key, "left_semi")


def halve_stock(inventory: DataFrame) -> DataFrame:
    """IO12: stock halved, rounding half up: int((stock + 1) / 2)."""
    return inventory.withColumn("stock", F.expr("div(stock + 1, 2)").cast("int"))


def thin_sales(sales: DataFrame, sale_id: str = "sale_id") -> DataFrame:
    """IO13: all sales of product 1, otherwise only even sale ids."""
    return sales.where((F.col("product_id") == PRODUCT_ONE) | (F.col(sale_id) % 2 == 0))


def reduce_model(m: Model, sale_id: str = "sale_id") -> Model:
    products = half_products(m.products)
    return m.with_tables(
        products=products,
        promotions=keep_referenced(m.promotions, products),
        inventory=halve_stock(keep_referenced(m.inventory, products)),
        sales=thin_sales(keep_referenced(m.sales, products), sale_id))


def orphan_counts(m: Model) -> DataFrame:
    """Referential check (the FKs Spark does not enforce): child rows without a product."""
    keys = m.products.select("product_id")
    out = None
    for name, df in (("sales", m.sales), ("promotions", m.promotions), ("inventory", m.inventory)):
        # rows per key first (partial aggregate), so only one row per key is shuffled
        part = (df.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
                .join(keys, "product_id", "left_anti")
                .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans"))
                .select(F.lit(name).alias("table"), "orphans"))
        out = part if out is None else out.unionByName(part)
    return out


# --- parameter table, statistics and sizes (IO4, IO14, IO15) ---------------------------------

def parameter_table(spark: SparkSession, name: str, **params: str) -> None:
    """IO4: CREATE TABLE name AS SELECT <params> - a one-row table of run parameters
    (e.g. the dataset mode) that later jobs read instead of a global."""
    cols = sorted(params)
    row = spark.createDataFrame([tuple(str(params[c]) for c in cols)], ", ".join(f"{c} string" for c in cols))
    row.write.mode("overwrite").saveAsTable(name)


def analyze(spark: SparkSession, table: str) -> None:
    """IO14: collect table statistics for a saved table (CBO / AQE use them)."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")


def table_size_gb(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """IO15: total bytes of a table's files in GB, listed by the binary-file source without
    reading file contents (only the ``length`` column is selected)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.agg(F.count(F.lit(1)).alias("files"),
                     F.sum("length").alias("bytes")).select(
        "files", "bytes", (F.col("bytes") / F.lit(1024.0 ** 3)).alias("size_gb"))


# --- synthetic tables (IO9) ---------------------------------------------------------------

def _u(seed: int, *cols: Column) -> Column:
    """A reproducible uniform [0, 1) draw per row (independent of partitioning)."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def synthetic_products(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    i = F.col("id")
    suffix = F.element_at(F.array(*[F.lit(s) for s in NAME_SUFFIXES]), (i % 5 + 1).cast("int"))
    return spark.range(1, n + 1).select(
        i.alias("product_id"),
        F.concat(F.lit("Product "), i.cast("string"), F.lit(" "), suffix).alias("product_name"),
        F.round((F.lit(GEN_PRICE_MIN) + _u(seed, i) * GEN_PRICE_SPAN) * 100).cast("bigint").alias("base_price"),
        (F.lit(1) + i % GEN_CATEGORIES).alias("category_id"),
        (F.lit(1) + i % GEN_SUPPLIERS).alias("supplier_id"),
        (_u(seed + 1, i) < GEN_AVAILABLE_SHARE).alias("available"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("last_update_time"))


def random_picks(keys: DataFrame, batches: int, per_batch: int, seed: int) -> DataFrame:
    """O4 per batch: ORDER BY random() LIMIT per_batch over the keys, independently for
    each batch (so each batch draws a key at most once)."""
    # every key once per batch (a generator, not a join), limited to per_batch per batch
    # before the shuffle
    pairs = (keys.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(batches - 1).cast("bigint"))))
             .withColumn("_r", _u(seed, F.col("batch"), F.col("product_id"))))
    return top_k_per_group(pairs, ["batch"], [F.col("_r")], per_batch).drop("_r", "_rn")


def synthetic_sales(products: DataFrame, batches: int, per_batch: int, seed: int = 7,
                    hot_share: float = 0.0) -> DataFrame:
    """Sales in batches like the reference generator; with ``hot_share`` > 0 that share of
    extra rows goes to product 1 so ranks and 'high demand' are not all ties."""
    picks = random_picks(products.select("product_id"), batches, per_batch, seed)
    k = F.monotonically_increasing_id()
    base = picks.select("product_id", "batch")
    if hot_share > 0:
        extra = int(batches * per_batch * hot_share)
        hot = products.sparkSession.range(extra).select(F.lit(PRODUCT_ONE).cast("bigint").alias("product_id"),
                                                        (F.col("id") % batches).alias("batch"))
        base = base.unionByName(hot)
    rows = base.withColumn("_k", k)
    return rows.select(
        F.col("_k").alias("sale_id"), "product_id",
        F.round(_u(seed + 1, F.col("_k")) * 800 * 100).cast("bigint").alias("sale_price"),
        (F.expr("TIMESTAMP_NTZ '2024-12-31 00:00:00'")
         - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                              (_u(seed + 2, F.col("_k")) * GEN_SALES_DAYS * 86400).cast("decimal(18,6)"))
         ).alias("sale_date"),
        F.round(_u(seed + 3, F.col("_k")) * 1000 * 100).cast("bigint").alias("price"))


def synthetic_promotions(products: DataFrame, batches: int, per_batch: int, seed: int = 11) -> DataFrame:
    picks = random_picks(products.select("product_id"), batches, per_batch, seed)
    k = F.xxhash64(F.col("batch"), F.col("product_id"))
    return picks.select(
        "product_id",
        F.round(_u(seed, k) * GEN_MAX_DISCOUNT * 100).cast("bigint").alias("promotion_discount"),
        (_u(seed + 1, k) < GEN_ACTIVE_PROMOTION_SHARE).alias("active"))


def synthetic_inventory(products: DataFrame, batches: int, per_batch: int, seed: int = 13) -> DataFrame:
    """W4 without an unpartitioned window: the round-robin warehouse comes from the key."""
    picks = random_picks(products.select("product_id"), batches, per_batch, seed)
    k = F.xxhash64(F.col("batch"), F.col("product_id"))
    return picks.select(
        "product_id",
        (F.lit(GEN_WAREHOUSES_FROM) + F.pmod(k, F.lit(GEN_WAREHOUSE_COUNT))).alias("warehouse_id"),
        F.floor(_u(seed, k) * GEN_MAX_STOCK).cast("int").alias("stock"))
