"""The pricing, cart and category views kept up to date by signed changes.

Every table is keyed and stored as changes (``SnapshotStore.keyed``). A batch finds the keys it
touches, computes their new rows from the stored state, and writes those whose value differs:

* sales: per product the count and the newest ``RESERVE`` distinct sales with signed
  multiplicities (a deleted sale is -1; a delete that comes before its insert waits as a negative
  entry). Below ``floor``, the oldest one kept, sales are only counted. When deletes leave fewer
  than ten of them, that product alone is read again from the sales.
* promotions: per product a multiset of discounts with the number of active and inactive rows.
* stock: an operation (a delta, or a restock that sets a value) is s -> max(a, s + b), and runs of
  them compose. Operations are leaves of a tree over seq with 1024 children a node; a batch
  composes the nodes above its operations again, so one that arrives late takes its own place.
* products: the newest update of price and category by seq.
* cart: a log of adds, and per ts the seq of its last delete; a row lives if it is younger.
* prices: the products that changed, those whose rank changed in the categories whose counts
  changed, and those whose place among the ten largest stocks changed are priced again.
* cart lines of touched products; signed differences of (total, count) per category, carried to
  all ancestors along the category closure and added to the stored totals.

All but the promotions' signed rows commute, so batches may come in any order and be cut anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import from_micros, micros, money
from ..operators import cart as C
from ..operators import changes as CH
from ..operators import hierarchy as H
from ..operators.pricing import assemble_factors, popularity_top, prices_from_factors, stock_top
from ..operators.ranking import top_k_per_group
from ..session import stage_table
from ..sources.model import RECENT_SALES, Model
from .store import SnapshotStore

RESERVE = 32          # distinct newest sales kept per product
SET_SHIFT = -(1 << 40)  # b of an operation that sets the stock whatever it was
FAN_BITS, TREE_LEVELS = 10, 4

CHANGES = ("sales", "toggles", "promotions", "ops", "updates", "adds", "cuts")


def _sale_columns(m: Model) -> list[str]:
    return ["sale_date", *[c for c in m.sale_tiebreak if c != "price"], "price"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class MaintainedViews:
    """The state and views of one model in one store."""

    def __init__(self, spark: SparkSession, m: Model, store: SnapshotStore, compact_every: int = 16):
        self.spark, self.m, self.store, self.compact_every = spark, m, store, compact_every
        types = {f.name: f.dataType.simpleString() for f in m.sales.schema}
        sale = ", ".join(f"{c}: {types[c]}" for c in _sale_columns(m))
        self.tables = {     # key columns, all columns
            "sales_agg": (["product_id"], f"product_id long, sale_count long, entries array<struct<s: struct<{sale}>, n: long>>, floor struct<{sale}>"),
            "promos": (["product_id"], "product_id long, kinds array<struct<d: long, on: long, off: long>>"),
            "clamps": (["product_id", "level", "node"], "product_id long, level int, node long, a long, b long"),
            "stock": (["product_id"], "product_id long, total_stock long"),
            "updates": (["product_id"], "product_id long, seq long, base_price long, category_id long, last_update_time timestamp_ntz"),
            "cuts": (["ts"], "ts timestamp_ntz, seq long"),
            "prices": (["product_id"], "product_id long, adjusted_price double, last_update_time timestamp_ntz"),
            "cart_lines": (["product_id", "product_name"], "product_id long, product_name string, category_id long, category_name string, price double, available_stock long"),
            "totals": (["category_id"], "category_id long, total_m long, item_count long, own_m long, own_count long"),
        }
        self.logs = {
            "sales_log": f"product_id long, {sale.replace(':', '')}, n long",
            "ops_log": "product_id long, seq long, a long, b long",
            "cart_log": "product_id long, product_name string, ts timestamp_ntz, seq long",
        }

    # --- reading ------------------------------------------------------------------------------

    def _at(self, version: int | None) -> tuple[int, int]:
        v = self.store.latest() if version is None else version
        return self.store.base_of(v), v

    def read(self, table: str, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
        key, ddl = self.tables[table]
        return self.store.keyed(table, ddl, key, *self._at(version), only)

    def read_log(self, table: str, at: tuple[int, int]) -> DataFrame:
        return self.store.log(table, self.logs[table], *at).drop("_gone", "_v")

    def prices(self, version: int | None = None) -> DataFrame:
        return self.read("prices", version)

    def cart_lines(self, version: int | None = None) -> DataFrame:
        return self.read("cart_lines", version)

    def category_totals(self, version: int | None = None) -> DataFrame:
        """V8 from the stored totals: a row per category with items below it and one "Other" row
        per category that has children and items of its own."""
        # (the caller's session plans this read: no side is broadcast for its small files)
        t, c = self.read("totals", version), self.m.categories.hint("merge")
        kids = H.parents_with_children(self.m.categories).withColumn("kids", F.lit(True)).hint("merge")
        j = t.join(c, "category_id").join(kids, "category_id", "left").withColumn("kids", F.coalesce("kids", F.lit(False)))
        whole = j.where("item_count > 0").select("category_id", "parent_id", F.col("kids").alias("has_subcategory"), "category_name",
                                                 from_micros(F.col("total_m")).alias("total"), "item_count")
        other = j.where("kids AND own_count > 0").select(
            (F.col("category_id") + H.OTHER_ID_OFFSET).alias("category_id"), F.col("category_id").alias("parent_id"), F.lit(False).alias("has_subcategory"),
            F.lit(H.OTHER_NAME).alias("category_name"), from_micros(F.col("own_m")).alias("total"), F.col("own_count").alias("item_count"))
        return whole.unionByName(other)

    # --- parts of the state -------------------------------------------------------------------

    def _entry_rows(self, sales: DataFrame, n) -> DataFrame:
        s = F.struct(*_sale_columns(self.m))
        return sales.select("product_id", s.alias("s"), n.alias("n")).groupBy("product_id", "s").agg(F.sum("n").alias("n"))

    def _kept(self, rows: DataFrame) -> DataFrame:
        """product_id, entries (newest first), cut: whether older ones were left out. ``rows``:
        net (product_id, s, n); at most RESERVE + 1 a product pass the shuffle."""
        top = top_k_per_group(rows.where("n <> 0"), ["product_id"], [F.col("s").desc()], RESERVE + 1)
        g = top.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("s", F.col("n").cast("long").alias("n"))), asc=False).alias("e"))
        return g.select("product_id", F.slice("e", 1, RESERVE).alias("entries"), (F.size("e") > RESERVE).alias("cut"))

    @staticmethod
    def _floor(entries="entries"):
        return F.element_at(entries, -1)["s"]

    def _all_sales(self, at: tuple[int, int]) -> DataFrame:
        cols = ["product_id", *_sale_columns(self.m)]
        base = self.m.sales.select(*cols, F.lit(1).cast("long").alias("n"))
        return base.unionByName(self.read_log("sales_log", at).select(*cols, "n"))

    def _sales_agg(self, ch: DataFrame, prev: tuple[int, int], now: tuple[int, int]) -> DataFrame:
        ids = ch.select("product_id")
        old = self.store.keyed("sales_agg", self.tables["sales_agg"][1], ["product_id"], *prev, ids)
        counts = ch.groupBy("product_id").agg(F.sum("n").alias("dn"))
        floors = old.select("product_id", "floor")
        # (a product without state hides nothing: all its sales are in the batch)
        news = self._entry_rows(ch, F.col("n")).join(floors, "product_id", "left").where("floor IS NULL OR s >= floor").drop("floor")
        # both sides are spread by product_id, and the grouping would rest on that: adaptive execution may
        # change one side's partitions afterwards ("Can't zip RDDs"), so the union is dealt out anew
        rows = old.select("product_id", F.inline("entries")).unionByName(news).repartition("product_id", "s")
        rows = rows.groupBy("product_id", "s").agg(F.sum("n").alias("n"))
        j = (counts.join(old.select("product_id", "sale_count", "floor"), "product_id", "left").join(self._kept(rows), "product_id", "left")
             .withColumn("sale_count", F.coalesce("sale_count", F.lit(0)) + F.col("dn"))
             .withColumn("floor", F.when(F.col("cut"), self._floor()).otherwise(F.col("floor")))
             .withColumn("held", F.expr("aggregate(coalesce(entries, array()), 0L, (t, x) -> t + greatest(x.n, 0L))")))
        j = stage_table(j.withColumn("dry", F.col("floor").isNotNull() & (F.col("held") < RECENT_SALES)), "sales-touched")
        dry = j.where("dry").select("product_id")
        again = self._kept(self._entry_rows(self._all_sales(now).join(dry, "product_id", "left_semi"), F.col("n")))
        again = again.select("product_id", F.col("entries").alias("e2"), F.when(F.col("cut"), self._floor()).alias("f2"))
        return (j.join(again, "product_id", "left")
                .select("product_id", "sale_count", F.when(F.col("dry"), F.col("e2")).otherwise(F.col("entries")).alias("entries"),
                        F.when(F.col("dry"), F.col("f2")).otherwise(F.col("floor")).alias("floor"), F.lit(False).alias("_gone")))

    def _promos(self, toggles: DataFrame, signed: DataFrame | None, prev: tuple[int, int]) -> DataFrame:
        known = toggles.join(self.m.products.select("product_id"), "product_id", "left_semi")
        per = known.groupBy("product_id").agg(F.count("*").alias("t"))
        ids = per.select("product_id") if signed is None else per.select("product_id").union(signed.select("product_id"))
        rows = self.store.keyed("promos", self.tables["promos"][1], ["product_id"], *prev, ids).select("product_id", F.inline("kinds"))
        if signed is not None:
            rows = rows.unionByName(signed.select("product_id", F.col("promotion_discount").alias("d"), F.when(F.col("active"), F.col("n")).otherwise(0).alias("on"),
                                                  F.when(F.col("active"), 0).otherwise(F.col("n")).alias("off")))
        g = self._kinds(rows).join(per, "product_id", "full_outer").withColumn("t", F.coalesce("t", F.lit(0)))
        # the first toggle of a product without promotions makes an active one, later ones flip it
        made = F.array(F.struct(F.lit(CH.NEW_PROMOTION_DISCOUNT).cast("long").alias("d"), F.lit(0).cast("long").alias("on"), F.lit(1).cast("long").alias("off")))
        has = F.coalesce(F.size("kinds"), F.lit(0)) > 0
        kinds = F.when(has, F.col("kinds")).when(F.col("t") > 0, made).otherwise(F.col("kinds"))
        flipped = F.transform(kinds, lambda k: F.struct(k["d"].alias("d"), k["off"].alias("on"), k["on"].alias("off")))
        return g.select("product_id", F.when(F.col("t") % 2 == 1, flipped).otherwise(kinds).alias("kinds"), F.lit(False).alias("_gone"))

    @staticmethod
    def _kinds(rows: DataFrame) -> DataFrame:
        """Multiset per product; distinct discounts are at most 10,001 (hundredths of a percent)."""
        g = rows.groupBy("product_id", "d").agg(F.sum("on").alias("on"), F.sum("off").alias("off")).where("on <> 0 OR off <> 0")
        return g.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("d", "on", "off"))).alias("kinds"))

    def _clamps(self, ops: DataFrame, prev: tuple[int, int], now: tuple[int, int]) -> DataFrame:
        """New tree nodes above the batch's operations, level by level."""
        ddl, key = self.tables["clamps"][1], self.tables["clamps"][0]
        parts, level = [], 0
        touched = ops.select("product_id", F.shiftright("seq", FAN_BITS).alias("node")).distinct()
        logged = self.read_log("ops_log", now).withColumn("node", F.shiftright("seq", FAN_BITS))
        kids = logged.join(touched, ["product_id", "node"], "left_semi").withColumnRenamed("seq", "child")
        while True:
            composed = stage_table(self._composed(kids).withColumn("level", F.lit(level)), f"clamps-{level}")
            parts.append(composed)
            level += 1
            if level == TREE_LEVELS:
                break
            up = F.shiftright("node", FAN_BITS) if level < TREE_LEVELS - 1 else F.lit(0).cast("long")
            parents = composed.select("product_id", up.alias("parent")).distinct()
            old = self.store.keyed("clamps", ddl, key, *prev, composed.select("product_id")).where(F.col("level") == level - 1)
            old = old.join(composed.select("product_id", "node"), ["product_id", "node"], "left_anti")
            nodes = old.select("product_id", "node", "a", "b").unionByName(composed.select("product_id", "node", "a", "b"))
            kids = (nodes.withColumn("parent", up).join(parents, ["product_id", "parent"], "left_semi")
                    .select("product_id", F.col("parent").alias("node"), F.col("node").alias("child"), "a", "b"))
        return _union([p.select("product_id", "level", "node", "a", "b", F.lit(False).alias("_gone")) for p in parts])

    @staticmethod
    def _composed(kids: DataFrame) -> DataFrame:
        """s -> max(a, s + b) of each node's children in order: b is their sum, a the largest a
        plus all later b. A shift as low as a restock's sets the stock, however low it is."""
        later = Window.partitionBy("product_id", "node").orderBy(F.col("child").desc(), F.col("b").desc(), F.col("a").desc()).rowsBetween(Window.unboundedPreceding, -1)
        r = kids.withColumn("later", F.coalesce(F.sum("b").over(later), F.lit(0)))
        return r.groupBy("product_id", "node").agg(F.max(F.col("a") + F.col("later")).alias("a"),
                                                   F.greatest(F.sum("b"), F.lit(SET_SHIFT).cast("long")).alias("b"))

    def _stock(self, roots: DataFrame) -> DataFrame:
        """Totals of the products whose operations changed; a product without inventory gets one
        row by its first restock."""
        inv = self.m.inventory.join(roots.select("product_id"), "product_id", "left_semi").select("product_id", "stock")
        j = roots.join(inv, "product_id", "left").where(F.col("stock").isNotNull() | (F.col("b") <= SET_SHIFT // 2))
        row = F.greatest(F.col("a"), F.coalesce("stock", F.lit(0)) + F.col("b"))
        return j.groupBy("product_id").agg(F.sum(row).alias("total_stock")).withColumn("_gone", F.lit(False))

    def _products(self, at: tuple[int, int], only: DataFrame | None = None) -> DataFrame:
        p = self.m.products.select("product_id", "product_name", "base_price", "category_id", "last_update_time")
        if only is not None:
            p = p.join(only.select("product_id").distinct(), "product_id", "left_semi")
        u = self.store.keyed("updates", self.tables["updates"][1], ["product_id"], *at, only)
        u = u.select("product_id", *[F.col(c).alias(f"u_{c}") for c in ("base_price", "category_id", "last_update_time")])
        return p.join(u, "product_id", "left").select("product_id", "product_name", *[F.coalesce(f"u_{c}", c).alias(c) for c in ("base_price", "category_id", "last_update_time")])

    def _counts(self, at: tuple[int, int], categories: DataFrame | None = None) -> DataFrame:
        """Products that sell with their count and category, of some categories or all."""
        p = self._products(at).select("product_id", "category_id")
        if categories is not None:
            p = p.join(categories.distinct(), "category_id", "left_semi")
        s = self.store.keyed("sales_agg", self.tables["sales_agg"][1], ["product_id"], *at, columns=["sale_count"])
        return s.where("sale_count > 0").select("product_id", "sale_count").join(p, "product_id")

    def _priced(self, at: tuple[int, int], only: DataFrame | None) -> DataFrame:
        """Prices from the state; ``only`` restricts them exactly."""
        read = lambda t, o=only, c=None: self.store.keyed(t, self.tables[t][1], ["product_id"], *at, o, c)
        products = self._products(at, only)
        taken = F.aggregate("entries", F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c")),
                            lambda t, x: F.struct((t["k"] + F.least(F.lit(RECENT_SALES) - t["k"], F.greatest(x["n"], F.lit(0)))).cast("long").alias("k"),
                                                  (t["c"] + F.least(F.lit(RECENT_SALES) - t["k"], F.greatest(x["n"], F.lit(0))) * x["s"]["price"]).cast("long").alias("c")))
        recent = read("sales_agg", c=["entries"]).withColumn("t", taken).where("t.k > 0").select("product_id", (money(F.col("t.c")) / F.col("t.k")).alias("avg_price"))
        promo = read("promos").select("product_id", F.array_min(F.transform(F.filter("kinds", lambda k: k["on"] > 0), lambda k: k["d"])).alias("promotion_discount"))
        counts = self._counts(at, None if only is None else products.select("category_id"))
        f = assemble_factors(products, recent, promo.where("promotion_discount IS NOT NULL"), popularity_top(counts),
                             stock_top(read("stock", None)), self.m.discount_keyword)
        return prices_from_factors(f)

    def _cart(self, at: tuple[int, int]) -> DataFrame:
        cuts = self.store.keyed("cuts", self.tables["cuts"][1], ["ts"], *at).select("ts", F.col("seq").alias("cut"))
        rows = self.m.shopping_cart.select("product_id", "product_name", "ts", F.lit(-1).cast("long").alias("seq")).unionByName(self.read_log("cart_log", at))
        return rows.join(cuts, "ts", "left").where("cut IS NULL OR seq > cut").select("product_id", "product_name", "ts")

    def _lines(self, at: tuple[int, int], prices: DataFrame, only: DataFrame | None) -> DataFrame:
        cart = self._cart(at)
        if only is not None:
            cart = cart.join(only, "product_id", "left_semi")
        stock = self.store.keyed("stock", self.tables["stock"][1], ["product_id"], *at, only).withColumnRenamed("total_stock", "stock")
        return C.cart_lines(self.m.with_tables(products=self._products(at, only), inventory=stock, shopping_cart=cart), prices=prices)

    # --- versions -----------------------------------------------------------------------------

    def bootstrap(self) -> None:
        """Version 0: the whole state from the base tables."""
        m, at = self.m, (0, 0)
        put = lambda t, df: self.store.write_changes(t, df if "_gone" in df.columns else df.withColumn("_gone", F.lit(False)), 0, full=True)
        for t, ddl in [*((t, d) for t, (_, d) in self.tables.items() if t in ("clamps", "updates", "cuts")), *self.logs.items()]:
            put(t, self.spark.createDataFrame([], ddl))
        kept = self._kept(self._entry_rows(m.sales, F.lit(1)))
        counts = m.sales.groupBy("product_id").agg(F.count("*").alias("sale_count"))
        put("sales_agg", counts.join(kept, "product_id").select("product_id", "sale_count", "entries", F.when(F.col("cut"), self._floor()).alias("floor")))
        on = F.col("active").cast("long")
        put("promos", self._kinds(m.promotions.select("product_id", F.col("promotion_discount").alias("d"), on.alias("on"), (1 - on).alias("off"))))
        put("stock", m.inventory.groupBy("product_id").agg(F.sum("stock").alias("total_stock")))
        put("prices", self._priced(at, None))
        put("cart_lines", self._lines(at, self.store.keyed("prices", self.tables["prices"][1], ["product_id"], *at), None))
        put("totals", self._carried(self.store.keyed("cart_lines", self.tables["cart_lines"][1], self.tables["cart_lines"][0], *at)
                                    .groupBy("category_id").agg(F.sum(micros(F.col("price"))).alias("m"), F.count("price").alias("k"))))
        self.store.commit(0, base=0, kind="bootstrap")

    def _carried(self, direct: DataFrame) -> DataFrame:
        """Sums (m, k) of categories carried to all their ancestors, own sums beside them."""
        up = direct.join(H.closure_of(self.m).select("category_id", "ancestor_id", "depth"), "category_id")
        own = lambda c: F.sum(F.when(F.col("depth") == 0, F.col(c)).otherwise(0))
        return up.groupBy(F.col("ancestor_id").alias("category_id")).agg(
            F.sum("m").alias("total_m"), F.sum("k").alias("item_count"), own("m").alias("own_m"), own("k").alias("own_count"))

    def apply(self, changes: dict[str, DataFrame], version: int, **meta) -> None:
        """Fold one batch of changes (see ``CHANGES``; any may be missing) into ``version`` and
        commit it."""
        store, base = self.store, self.store.base_of(version - 1)
        prev, now = (base, version - 1), (base, version)
        empty = {t: self.spark.createDataFrame([], d) for t, d in self.logs.items()}
        state = lambda t, at, only=None: store.keyed(t, self.tables[t][1], self.tables[t][0], *at, only)
        none = self.spark.createDataFrame([], "product_id long")

        def put(table: str, df: DataFrame | None) -> None:
            ddl = self.tables[table][1] if table in self.tables else self.logs[table]
            df = self.spark.createDataFrame([], ddl) if df is None else df
            store.write_changes(table, df if "_gone" in df.columns else df.withColumn("_gone", F.lit(False)), version)

        def differing(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
            """Rows of ``new`` that are not so in ``old``, and the keys that left."""
            rest = [c for c in new.columns if c not in key]
            a = new.select(*key, F.struct(*rest).alias("x"))
            b = old.select(*key, F.struct(*rest).alias("y"))
            j = a.join(b, key, "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
            return j.select(*key, F.col("x").isNull().alias("_gone"), "x.*")

        get = changes.get
        # logs and state
        cols = ["product_id", *_sale_columns(self.m)]
        put("sales_log", get("sales").select(*cols, F.col("n").cast("long").alias("n")) if get("sales") is not None else None)
        put("ops_log", get("ops"))
        adds = get("adds")
        if adds is not None:
            adds = adds.join(self.m.products.select("product_id", "product_name"), "product_id").select("product_id", "product_name", "ts", "seq")
        put("cart_log", adds)
        sales = store.spark.read.schema(self.logs["sales_log"]).parquet(store.path("sales_log", version))
        ops = store.spark.read.schema(self.logs["ops_log"]).parquet(store.path("ops_log", version))
        put("sales_agg", self._sales_agg(sales, prev, now))
        toggles = get("toggles") if get("toggles") is not None else none
        put("promos", self._promos(toggles, get("promotions"), prev))
        put("clamps", self._clamps(ops, prev, now))
        roots = state("clamps", now, ops.select("product_id")).where(F.col("level") == TREE_LEVELS - 1)
        put("stock", self._stock(roots))
        news = get("updates")
        if news is not None:
            newest = news.groupBy("product_id").agg(F.max(F.struct("seq", "base_price", "category_id", "last_update_time")).alias("u")).select("product_id", "u.*")
            old = state("updates", prev, newest.select("product_id")).select("product_id", F.col("seq").alias("old_seq"))
            news = newest.join(old, "product_id", "left").where("old_seq IS NULL OR seq > old_seq").drop("old_seq")
        put("updates", news)
        cuts = get("cuts")
        if cuts is not None:
            mine = cuts.groupBy("ts").agg(F.max("seq").alias("seq"))
            old = state("cuts", prev, mine.select("ts")).select("ts", F.col("seq").alias("old_seq"))
            cuts = mine.join(old, "ts", "left").where("old_seq IS NULL OR seq > old_seq").drop("old_seq")
        put("cuts", cuts)
        wrote = lambda t: store.spark.read.schema(self.tables[t][1]).parquet(store.path(t, version))
        # products to price: touched ones, and those whose rank moved
        touched = [wrote(t).select("product_id") for t in ("sales_agg", "promos", "updates")]
        recount = wrote("sales_agg").select("product_id").union(wrote("updates").select("product_id")).distinct()
        cats = stage_table(self._products(prev, recount).select("category_id").union(self._products(now, recount).select("category_id")).distinct(), "touched-categories")
        moved = differing(popularity_top(self._counts(now, cats)).where("popularity_rank IS NOT NULL"),
                          popularity_top(self._counts(prev, cats)).where("popularity_rank IS NOT NULL"), ["product_id"])
        place = differing(stock_top(state("stock", now)), stock_top(state("stock", prev)), ["product_id"])
        ids = stage_table(_union([*touched, moved.select("product_id"), place.select("product_id")]).distinct(), "touched-products")
        put("prices", differing(self._priced(now, ids), state("prices", prev, ids), ["product_id"]))
        # cart lines of touched products, and what their difference adds to every ancestor
        cut_ts = wrote("cuts").select("ts")
        in_cart = self.m.shopping_cart.select("product_id", "ts").unionByName(self.read_log("cart_log", now).select("product_id", "ts"))
        lines_of = _union([wrote("prices").select("product_id"), wrote("stock").select("product_id"), wrote("updates").select("product_id"),
                           store.spark.read.schema(self.logs["cart_log"]).parquet(store.path("cart_log", version)).select("product_id"),
                           in_cart.join(cut_ts, "ts", "left_semi").select("product_id")]).distinct()
        lines_of = stage_table(lines_of, "touched-lines")
        key = self.tables["cart_lines"][0]
        old_lines = state("cart_lines", prev, lines_of)
        put("cart_lines", differing(self._lines(now, state("prices", now, lines_of), lines_of), old_lines, key))
        changed = wrote("cart_lines").select(*key)
        sums = lambda df, sign: df.where("price IS NOT NULL").select("category_id", (sign * micros(F.col("price"))).alias("m"), F.lit(sign).cast("long").alias("k"))
        delta = (sums(state("cart_lines", prev, changed), -1).unionByName(sums(state("cart_lines", now, changed), 1))
                 .groupBy("category_id").agg(F.sum("m").alias("m"), F.sum("k").alias("k")).where("m <> 0 OR k <> 0"))
        plus = stage_table(self._carried(delta), "category-deltas")
        old = state("totals", prev, plus.select("category_id"))
        both = plus.unionByName(old.select(*plus.columns)).groupBy("category_id").agg(*[F.sum(c).alias(c) for c in plus.columns[1:]])
        put("totals", both.withColumn("_gone", F.col("item_count") == 0))
        if version - base >= self.compact_every:
            for t in self.tables:
                store.write_changes(t, state(t, now).withColumn("_gone", F.lit(False)), version, full=True)
            for t in self.logs:
                store.write_changes(t, self.read_log(t, now).withColumn("_gone", F.lit(False)), version, full=True)
            base = version
        store.commit(version, base=base, **meta)
