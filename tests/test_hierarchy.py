"""Category rollup fixtures (S7, S9-S12) and invariants."""

import pytest

from helpers import make_model
from livepricing.operators import cart as C
from livepricing.operators import hierarchy as H


def tree_model(spark):
    # 4-level tree 1 > 2 > 3 > 4, a sibling 5 under 1 with no items, item directly on 2
    cats = [(1, "root", None), (2, "mid", 1), (3, "low", 2), (4, "leaf", 3), (5, "empty", 1)]
    products = [(10, "x", 1000, 4), (11, "y", 2000, 2), (12, "z", 500, 4)]
    sales = [(1, 10, 1000, 0), (2, 11, 2000, 0), (3, 12, 500, 0)]
    cart = [(10, "x", 0), (10, "x", 1), (11, "y", 2), (12, "z", 3)]
    return make_model(spark, products, sales, inventory=[(10, 4), (10, 3)],
                      categories=cats, cart=cart)


def test_cart_lines_group_duplicates_and_multiply_stock(spark):
    m = tree_model(spark)
    lines = {r["product_id"]: r for r in C.cart_lines(m).collect()}
    assert set(lines) == {10, 11, 12}
    assert lines[10]["available_stock"] == 2 * (4 + 3)   # two cart rows x stock sum
    assert lines[12]["available_stock"] == 0


def test_rollup_other_rows_and_hidden_empty_subtrees(spark):
    m = tree_model(spark)
    lines = C.cart_lines(m)
    rows = {r["category_id"]: r for r in H.category_totals(m, lines).collect()}
    assert 5 not in rows                                  # empty subtree hidden
    assert rows[1]["item_count"] == 3 and rows[4]["item_count"] == 2
    assert rows[1002]["category_name"] == "Other" and rows[1002]["parent_id"] == 2
    assert rows[1002]["item_count"] == 1 and not rows[1002]["has_subcategory"]
    assert rows[2]["has_subcategory"] and not rows[4]["has_subcategory"]
    # parent total = sum of child totals + its Other row
    assert rows[2]["total"] == pytest.approx(rows[3]["total"] + rows[1002]["total"])
    # invariant: root total = cart total
    total = C.cart_total(lines).collect()[0]["cart_total"]
    assert round(rows[1]["total"], 2) == total


def test_drilldown_expanded_parsing(spark):
    assert H.parse_expanded("") == [] and H.parse_expanded("x") == []
    assert H.parse_expanded(" 1, 2 ") == [1, 2]
    m = tree_model(spark)
    lines = C.cart_lines(m)
    only_roots = [r["category_id"] for r in H.drilldown(m, lines, "x").collect()]
    assert only_roots == [1]
    opened = [r["category_id"] for r in H.drilldown(m, lines, "1, 2").collect()]
    assert opened == [1, 2, 3, 1002]    # one level below each listed id, tree order


def test_cycle_raises(spark):
    cats = spark.createDataFrame([(1, "a", 2), (2, "b", 1)],
                                 "category_id bigint, category_name string, parent_id bigint")
    with pytest.raises(H.CategoryCycleError):
        H.ancestor_pairs(cats)


def test_a_tree_of_any_depth(spark):
    n = 150
    cats = spark.createDataFrame([(i, str(i), i - 1 if i else None) for i in range(n)],
                                 "category_id bigint, category_name string, parent_id bigint")
    got = {(r.category_id, r.ancestor_id, r.depth) for r in H.ancestor_pairs(cats).collect()}
    assert got == {(i, j, i - j) for i in range(n) for j in range(i + 1)}


def test_a_cycle_above_a_branch_raises(spark):
    cats = spark.createDataFrame([(1, "a", 3), (2, "b", 1), (3, "c", 2), (4, "d", 1), (5, "e", None)],
                                 "category_id bigint, category_name string, parent_id bigint")
    with pytest.raises(H.CategoryCycleError):
        H.ancestor_pairs(cats)


def test_cart_lines_run_no_job_while_built(spark):
    from conftest import SF_SMALL
    from livepricing.sources.model import from_driver_tables
    m = from_driver_tables(spark, SF_SMALL)
    spark.sparkContext.setJobGroup("cart-lines-build", "")
    lines = C.cart_lines(m)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("cart-lines-build")
    spark.sparkContext.setJobGroup("cart-lines-run", "")
    assert lines.count() > 1


def test_drilldown_rows_come_in_tree_order(spark):
    from conftest import SF_SMALL
    from livepricing.sources.model import from_driver_tables
    m = from_driver_tables(spark, SF_SMALL)
    rows = [(r.parent_id, r.category_id) for r in H.drilldown(m, C.cart_lines(m), "1,2,3,4,5").collect()]
    keys = [((p if p is not None else c), c) for p, c in rows]
    assert keys == sorted(keys) and len(rows) > 5


def test_empty_cart(spark):
    cats = [(1, "root", None), (2, "leaf", 1)]
    m = make_model(spark, [(10, "x", 1000, 2)], [(1, 10, 1000, 0)], categories=cats, cart=[])
    lines = C.cart_lines(m)
    assert lines.count() == 0
    assert C.cart_total(lines).first().cart_total == 0.0
    assert H.category_totals(m, lines).count() == 0
    assert H.drilldown(m, lines, "1").count() == 0
    msg = C.cart_message(lines).first()
    assert msg.item_count == 0 and "(0 items totaling $0.00)" in msg.message
