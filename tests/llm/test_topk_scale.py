"""Top-k with components of any finite size, many slices of queries, and one tree per shard."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("livepricing.llm")
from livepricing.llm import topk  # noqa: E402


def brute(data, scale=256, k=5):
    """Ranks by Python integers, scores saturated."""
    most = np.finfo(float).max
    ints = {i: [int(np.floor(max(min(scale * x, most), -most))) for x in v] for i, v in data}
    want = []
    for q in sorted(i for i in ints if i % 50 == 0):
        s = sorted((-min(max(sum(a * b for a, b in zip(ints[q], v)), topk.LEAST), topk.MOST), i) for i, v in ints.items() if i != q)[:k]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return want


@pytest.mark.parametrize("huge", [2e12, 1e18, 1e30, 1e308])
def test_components_of_any_size(spark, huge):
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=3).tolist()) for i in range(120)]
    # scores over and under a long, components that meet zeros, sums that cancel
    data += [(150, [huge, 0.0, 0.0]), (151, [-huge, 0.0, 1.0]), (152, [0.0, 1.0, 0.0]), (200, [0.0, huge, -huge]), (201, [1.0, huge, huge])]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for shard_rows, query_rows in ((1 << 14, 1 << 10), (30, 2)):
        got = topk.top_k(topk.quantised(d), F.col("vec_id") % 50 == 0, shard_rows=shard_rows, query_rows=query_rows)
        assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == brute(data)


def test_a_shard_builds_one_tree(monkeypatch):
    """The stream of a shard in many batches: one tree, queries in slices."""
    import pandas as pd

    built, slices = [], []
    tree, search = topk.KDTree.__init__, topk.Shard.search
    monkeypatch.setattr(topk.KDTree, "__init__", lambda self, p: (built.append(len(p)), tree(self, p))[1])
    monkeypatch.setattr(topk.Shard, "search", lambda self, q, k: (slices.append(len(q)), search(self, q, k))[1])
    rng = np.random.default_rng(1)
    rows = [(s, 0, ask, 1000 * s + 500 * ask + i, None, rng.integers(-9, 9, 4).astype(float)) for s in (3, 7) for ask in (False, True) for i in range(50)]
    frame = pd.DataFrame(rows, columns=["shard", "part", "is_query", "vec_id", "kth", "vec"])
    batches = [frame[i: i + 17] for i in range(0, len(frame), 17)]
    got = pd.concat(topk._search(5, 8)(iter(batches)))
    assert built == [50, 50] and max(slices) <= 8 and len(got) == 2 * 50 * 5


def test_empty(spark):
    d = spark.createDataFrame([(50, None), (None, [1.0])], "vec_id long, embedding array<double>")
    for x in (d, d.limit(0)):
        assert topk.top_k(topk.quantised(x), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(topk.quantised(one), F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 51, 256 * 512)]
