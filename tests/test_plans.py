"""Plan-shape checks: the scale properties the operators are built for."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

# builders that run a stream or write while building are covered by their own tests
SIDE_EFFECTS = {"stream_pricing", "stream_cart", "stream_category_totals", "snapshot_read", "stream_changelog", "stream_trailing_rate",
                "stream_replica", "stream_rate", "cached_refresh", "load_csv",
                "point_read_cached", "point_read_incremental"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SIDE_EFFECTS))
def test_no_cross_products(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_recent_prices_limit_rows_before_the_shuffle(spark):
    plan = plan_of(E.queries()["recent_prices"](spark, SF_SMALL))
    # the partial group limit runs under the shuffle, the final one above it
    partial = plan.index("WindowGroupLimit [product_id")
    assert "Partial" in plan and "Final" in plan
    assert plan.rfind("Exchange hashpartitioning(product_id") < plan.rfind("WindowGroupLimit")
    assert partial >= 0


def test_point_lookup_pushes_the_key_into_the_scans(spark):
    df = E.queries()["price_point_lookup"](spark, SF_SMALL)
    plan = plan_of(df)
    assert "PushedFilters: [IsNotNull(l_partkey), EqualTo(l_partkey,1)" in plan or \
           "In(l_partkey, [1])" in plan or "EqualTo(l_partkey,1)" in plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(E.queries()["dynamic_pricing"](spark, SF_SMALL))
    # no lineitem scan reads the tax or the comment-like columns it does not need
    assert "l_tax" not in plan


def test_flagship_reads_each_aggregate_once(spark):
    """Sales are read for the newest ten and for the counts, promotions and inventory once;
    the second readers of counts and stock totals reuse an exchange."""
    df = E.queries()["dynamic_pricing"](spark, SF_SMALL)
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert sum("FileScan" in line and "lineitem.parquet" in line for line in final.splitlines()) <= 4
    assert final.count("ReusedExchange") >= 2
