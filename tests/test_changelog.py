"""The commit frontier over pieces of transactions."""

import pytest

from livepricing.streaming.changelog import frontier_of, to_changelog


def records(spark, rows):
    return spark.createDataFrame(rows, "txn long, part long, kind string, size long")


@pytest.mark.parametrize("rows, done, want", [
    ([], 4, 4),
    ([(5, 0, "end", 0), (6, 0, "end", 1), (6, 1, "sales", None)], 4, 6),
    ([(5, 0, "end", 0), (6, 0, "end", 2), (6, 1, "sales", None), (7, 0, "end", 0)], 4, 5),      # 6 lacks a change
    ([(6, 0, "end", 0), (7, 0, "end", 0)], 4, 4),                                               # 5 has not come
    ([(5, 1, "sales", None), (6, 0, "end", 0)], 4, 4),                                          # 5 has no end yet
    ([(5, 0, "end", 0), (7, 0, "end", 0), (8, 0, "end", 0)], 4, 5),                             # a gap
])
def test_frontier(spark, rows, done, want):
    assert frontier_of(records(spark, rows), done) == want


def test_changelog_counts_equal_changes(spark):
    """Equal changes of one transaction are records of their own, repeated delivery is not."""
    sales = spark.createDataFrame([(1, 10, 7), (1, 10, 7), (2, 20, 8)], "product_id long, price long, seq long")
    cuts = spark.createDataFrame([(7,)], "seq long")
    log = to_changelog({"sales": sales, "cuts": cuts}, spark.createDataFrame([(7,), (8,), (9,)], "txn long"))
    ends = {r.txn: r.size for r in log.where("kind = 'end'").collect()}
    assert ends == {7: 3, 8: 1, 9: 0}
    assert log.union(log).dropDuplicates(["txn", "kind", "part"]).count() == log.count() == 7
    assert frontier_of(log, 6) == 9
