"""Loading and table-maintenance operators on hand-made CSV fixtures."""

import os
import tempfile

from pyspark.sql import functions as F

import pytest

from livepricing.sources import ingest as IN
from livepricing.sources import schemas as S


def _write(folder, name, text):
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_csv_model_load_dedup_and_correction(spark):
    d = tempfile.mkdtemp(prefix="lp-csv-")
    _write(d, "categories.csv", "category_id,category_name,parent_id\n1,Food,\n2,Fruit,1\n")
    _write(d, "products.csv",
           "product_id,product_name,base_price,category_id,supplier_id,available,last_update_time\n"
           "1,Apple,1.10,2,1,t,2024-01-01 00:00:00\n"
           "1,Apple new,1.20,2,1,t,2024-02-01 00:00:00\n"
           "2,Cheap pear,0.50,2,1,f,2024-01-01 00:00:00\n")
    _write(d, "sales.csv", "sale_id,product_id,sale_price,sale_date,price\n"
                           "1,1,1.00,2024-01-02 00:00:00,1.10\n2,2,0.45,2024-01-03 00:00:00,0.50\n")
    _write(d, "promotions.csv", "promotion_id,product_id,promotion_discount,start_date,end_date,active,updated_at\n"
                                "1,1,10.00,2024-01-01 00:00:00,2024-02-01 00:00:00,t,2024-01-01 00:00:00\n")
    _write(d, "inventory.csv", "inventory_id,product_id,stock,warehouse_id,restock_date\n"
                               "1,1,5,2,2024-01-01 00:00:00\n")
    m = IN.load_csv_model(spark, d, dataset="retail")
    cats = {r.category_id: r.parent_id for r in m.categories.collect()}
    assert cats == {1: None, 2: 1}                       # empty field -> NULL
    prods = {r.product_id: r for r in m.products.collect()}
    assert prods[1].product_name == "Fresh Red Delicious Apple" and prods[1].base_price == 75
    assert prods[2].available is False and prods[2].base_price == 50
    assert [r.promotion_discount for r in m.promotions.collect()] == [1000]
    assert sorted(r.price for r in m.sales.collect()) == [50, 110]


def test_reduced_dataset_rules(spark):
    products = spark.createDataFrame([(i, f"p{i}") for i in [1, 2, 3, 4, 5, 6, 7]],
                                     "product_id bigint, product_name string")
    kept = sorted(r.product_id for r in IN.half_products(products).collect())
    assert kept == [1, 2, 4, 6]                          # 1, then every other of 2..7
    inv = spark.createDataFrame([(2, 5), (2, 4), (3, 9)], "product_id bigint, stock int")
    halved = sorted(r.stock for r in IN.halve_stock(IN.keep_referenced(inv, products.where("product_id = 2"))).collect())
    assert halved == [2, 3]
    sales = spark.createDataFrame([(1, 1), (3, 1), (4, 2), (5, 2)], "sale_id bigint, product_id bigint")
    assert sorted(r.sale_id for r in IN.thin_sales(sales).collect()) == [1, 3, 4]


def test_dedup_keeps_newest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "c", 2), (1, "d", 2)],
                               "product_id bigint, product_name string, last_update_time int")
    got = {r.product_id: r.product_name for r in IN.dedup_latest(df).collect()}
    assert got == {1: "b", 2: "c"}


def test_parameter_table_and_analyze(spark):
    IN.parameter_table(spark, "lp_demo_mode", mode="retail")
    assert spark.table("lp_demo_mode").first().mode == "retail"
    IN.analyze(spark, "lp_demo_mode")
    stats = spark.sql("DESCRIBE TABLE EXTENDED lp_demo_mode").where(F.col("col_name") == "Statistics").first()
    assert stats is not None and "bytes" in stats.data_type


def test_table_size_lists_files_only(spark):
    got = IN.table_size_gb(spark, "/root/testdata/sf0.001").first()
    assert got.files >= 8 and got.bytes > 0


def test_generator_picks_and_warehouses(spark):
    products = IN.synthetic_products(spark, 50)
    picks = IN.random_picks(products.select("product_id"), batches=4, per_batch=20, seed=3)
    per_batch = {r.batch: r.n for r in picks.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert per_batch == {0: 20, 1: 20, 2: 20, 3: 20}
    assert picks.select("batch", "product_id").distinct().count() == 80   # no key twice per batch
    inv = IN.synthetic_inventory(products, 2, 10)
    whs = {r.warehouse_id for r in inv.select("warehouse_id").distinct().collect()}
    assert whs <= {2, 3, 4, 5, 6} and inv.count() == 20
    assert all(0 <= r.stock < 1000 for r in inv.collect())
    sales = IN.synthetic_sales(products, 3, 50, hot_share=0.3)
    counts = {r.product_id: r.n for r in sales.groupBy("product_id").agg(F.count("*").alias("n")).collect()}
    assert counts[1] == 3 + int(3 * 50 * 0.3)                               # the hot product


def test_unknown_boolean_text_is_an_error(spark, tmp_path):
    schema = spark.createDataFrame([], "id bigint, ok boolean").schema
    (tmp_path / "good.csv").write_text("id,ok\n1,t\n2,No\n3,\n4, TRUE \n")
    got = {r.id: r.ok for r in IN.read_csv(spark, str(tmp_path / "good.csv"), schema).collect()}
    assert got == {1: True, 2: False, 3: None, 4: True}
    (tmp_path / "bad.csv").write_text("id,ok\n1,maybe\n")
    with pytest.raises(Exception, match="ok is no boolean: maybe"):
        IN.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()


def test_dedup_breaks_ties_by_columns(spark):
    rows = [(1, "a", 5, 0), (1, "b", 5, 0), (1, None, 5, 0)]
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "product_id bigint, product_name string, base_price int, last_update_time int")
        assert [x.product_name for x in IN.dedup_latest(df, tiebreak=("base_price", "product_name")).collect()] == ["b"]


def test_a_model_follows_its_files(spark, tmp_path):
    import shutil

    from livepricing.plans.registry import model_for
    folder = tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", folder, copy_function=shutil.copyfile)
    folder.chmod(0o755)
    first = model_for(spark, str(folder))
    first.extra["kept"] = True
    assert model_for(spark, str(folder)) is first
    spark.read.parquet(f"{folder}/region.parquet").limit(2).write.parquet(str(folder / "region2.parquet"))
    again = model_for(spark, str(folder))
    assert again is not first and "kept" not in again.extra
