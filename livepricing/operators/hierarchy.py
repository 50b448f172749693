"""Category tree operators: ancestor closure, bottom-up rollup with "Other" rows, and the
category lists the cart API serves.

The rollup re-emits each category's direct (total, count) to every ancestor. Instead of
recursing over the cart data, we recurse over the *category tree only* (an ancestor
closure, whose reach doubles per round), then do one join + one aggregate. Only categories that
hold items feed the aggregate; categories with zero items in their subtree are hidden
anyway, so the result is identical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import from_micros, micros, round2_from_micros
from ..session import stage_table
from ..sources.model import Model

# Fixed values that must equal the reference's for the same results.
OTHER_ID_OFFSET = 1000
OTHER_NAME = "Other"


class CategoryCycleError(RuntimeError):
    pass


def ancestor_pairs(categories: DataFrame) -> DataFrame:
    """(category_id, ancestor_id, depth, ancestor attributes): every category with itself
    (depth 0) and each of its ancestors. The reach doubles with every round, so a tree of any
    depth takes as many rounds as its depth has binary digits. A round is one written table (in
    the shared folder) and one aggregate, from which the driver learns whether jumps are left and
    whether a category has become its own ancestor, which raises ``CategoryCycleError``."""
    pairs = categories.select("category_id", F.col("category_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    jump = (categories.where(F.col("parent_id").isNotNull())
            .select(F.col("category_id").alias("_from"), F.col("parent_id").alias("_to")))
    step, more = 1, True    # pairs hold depths below step, jump the ancestor at depth step
    while more:
        further = (pairs.join(jump, F.col("ancestor_id") == F.col("_from"))
                   .select("category_id", F.col("_to").alias("ancestor_id"), (F.col("depth") + step).alias("depth")))
        ahead = jump.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
        # jumps are stored beside the pairs, without a depth
        jumps = (jump.join(ahead, F.col("_to") == F.col("_mid"))
                 .select(F.col("_from").alias("category_id"), F.col("_end").alias("ancestor_id"), F.lit(None).cast("int").alias("depth")))
        held = stage_table(pairs.unionByName(further).unionByName(jumps), "category-pairs")
        seen = held.agg(F.max(F.col("depth").isNull()).alias("more"),
                        F.max((F.col("depth") > 0) & (F.col("category_id") == F.col("ancestor_id"))).alias("cycle")).first()
        if seen.cycle:
            raise CategoryCycleError("a category is its own ancestor")
        pairs, more = held.where("depth IS NOT NULL"), bool(seen.more)
        jump = held.where("depth IS NULL").select(F.col("category_id").alias("_from"), F.col("ancestor_id").alias("_to"))
        step *= 2
    # each pair carries its ancestor's attributes, so rollups need no further joins
    attrs = categories.select(F.col("category_id").alias("ancestor_id"),
                              F.col("parent_id").alias("ancestor_parent"),
                              F.col("category_name").alias("ancestor_name"),
                              F.lit(True).alias("ancestor_known"))
    kids = parents_with_children(categories).select(
        F.col("category_id").alias("ancestor_id"), F.lit(True).alias("ancestor_has_children"))
    out = (pairs.join(attrs, "ancestor_id", "left").join(kids, "ancestor_id", "left")
           .select("category_id", "ancestor_id", "depth", "ancestor_parent", "ancestor_name",
                   F.coalesce("ancestor_known", F.lit(False)).alias("ancestor_known"),
                   F.coalesce("ancestor_has_children", F.lit(False)).alias("ancestor_has_children")))
    return stage_table(out, "category-closure")


def closure_of(m: Model) -> DataFrame:
    """The model's ancestor closure, materialised once per model: the tree is near-static
    and every rollup reuses it (the counterpart of a maintained index on parent_id)."""
    if "closure" not in m.extra:
        m.extra["closure"] = ancestor_pairs(m.categories)
    return m.extra["closure"]


def parents_with_children(categories: DataFrame) -> DataFrame:
    return (categories.where(F.col("parent_id").isNotNull())
            .select(F.col("parent_id").alias("category_id")).distinct())


def has_subcategory(categories: DataFrame) -> DataFrame:
    """Every category with a flag telling whether any category names it as parent."""
    kids = parents_with_children(categories).withColumn("_has", F.lit(True))
    return (categories.select("category_id").distinct().join(kids, "category_id", "left")
            .select("category_id", F.coalesce("_has", F.lit(False)).alias("has_subcategory")))


def direct_totals(lines: DataFrame) -> DataFrame:
    """Per category: exact sum of item prices (millionths) and number of priced items."""
    return (lines.groupBy("category_id")
            .agg(F.sum(micros(F.col("price"))).alias("total_m"),
                 F.count("price").alias("item_count"))
            .where(F.col("item_count") > 0))


def category_totals_exact(m: Model, lines: DataFrame) -> DataFrame:
    """V8 with exact totals in millionths (``total_m``), as one linear plan.

    Each category's direct (total, count) is joined to its ancestor pairs, which carry the
    ancestor's name, parent and has-children flag. Every pair contributes to its ancestor's
    rollup (role T); the depth-0 pair also contributes the category's own direct items
    (role O, the candidate "Other" row). One aggregate sums both roles and one projection
    shapes both kinds of rows; nothing below is computed twice."""
    direct = direct_totals(lines)
    role = F.filter(F.array(F.lit("T"), F.when(F.col("depth") == 0, F.lit("O"))), lambda r: r.isNotNull())
    agg = (direct.join(closure_of(m), "category_id")
           .select(F.explode(role).alias("role"), "ancestor_id", "ancestor_parent", "ancestor_name",
                   "ancestor_known", "ancestor_has_children", "total_m", "item_count")
           .groupBy("role", "ancestor_id", "ancestor_parent", "ancestor_name", "ancestor_known",
                    "ancestor_has_children")
           .agg(F.sum("total_m").alias("total_m"), F.sum("item_count").alias("item_count"))
           .where(F.col("item_count") > 0))
    total = F.col("role") == "T"
    has = F.col("ancestor_has_children")
    key = F.col("ancestor_id")
    return (agg
            # rollup rows need a real category; "Other" rows need children (and items)
            .where((total & F.col("ancestor_known")) | (~total & has))
            .select(F.when(total, key).otherwise(key + OTHER_ID_OFFSET).alias("category_id"),
                    F.when(total, F.col("ancestor_parent")).otherwise(key).alias("parent_id"),
                    (total & has).alias("has_subcategory"),
                    F.when(total, F.col("ancestor_name")).otherwise(F.lit(OTHER_NAME)).alias("category_name"),
                    "total_m", "item_count"))


def category_totals(m: Model, lines: DataFrame) -> DataFrame:
    """V8: category_id, parent_id, has_subcategory, category_name, total, item_count."""
    t = category_totals_exact(m, lines)
    return t.select("category_id", "parent_id", "has_subcategory", "category_name",
                    from_micros(F.col("total_m")).alias("total"),
                    F.col("item_count").cast("bigint").alias("item_count"))


def parse_expanded(expanded: str | None) -> list[int]:
    """The request's comma list, keeping only all-digit tokens."""
    if not expanded:
        return []
    return [int(t.strip()) for t in expanded.split(",") if t.strip().isdigit()]


def drilldown(m: Model, lines: DataFrame, expanded: str | None,
              totals: DataFrame | None = None) -> DataFrame:
    """Root categories plus the children of the expanded ids, with rounded subtotals
    and the grand total over the roots only, in tree order."""
    ids = parse_expanded(expanded)
    # read twice (rows and grand total): the rollup, bounded by the cart's categories, is written once
    t = totals if totals is not None else stage_table(category_totals_exact(m, lines), "category-totals")
    keep = F.col("parent_id").isNull()
    if ids:   # an all-junk list behaves like no list
        keep = keep | F.col("parent_id").isin(ids)
    # the grand total over the roots is a scalar subquery over the same rollup
    grand = (t.where(F.col("parent_id").isNull()).agg(F.coalesce(F.sum("total_m"), F.lit(0)).alias("_g"))
             .select(round2_from_micros("_g")).scalar())
    return (t.where(keep)
            .select("category_id", "parent_id", "has_subcategory", "category_name",
                    F.col("item_count").cast("bigint").alias("item_count"),
                    round2_from_micros("total_m").alias("subtotal"), grand.alias("categories_total"))
            .orderBy(F.coalesce("parent_id", "category_id"), "category_id"))


def category_list(m: Model) -> DataFrame:
    """Distinct (id, name) pairs ordered by name."""
    return (m.categories.select("category_id", "category_name").distinct()
            .orderBy("category_name", "category_id"))


def subtotals_by_name(m: Model, lines: DataFrame) -> DataFrame:
    """Name, item_count, subtotal of every visible category row, by name."""
    return (category_totals(m, lines)
            .select("category_name", "item_count", F.col("total").alias("subtotal"))
            .orderBy("category_name"))
