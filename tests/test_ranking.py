"""Skew-safe ranks equal brute-force SQL RANK on random data with a hot group and ties."""

import random

import pytest

from livepricing.operators.ranking import full_rank, top_k_rank


def brute_rank(rows):
    out = {}
    for rid, g, v in rows:
        out[rid] = 1 + sum(1 for _, g2, v2 in rows if g2 == g and v2 > v)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_full_and_top_k_rank(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for rid in range(400):
        g = 0 if rnd.random() < 0.4 else rnd.randint(1, 6)    # group 0 is hot
        rows.append((rid, g, rnd.randint(0, 15)))              # many ties
    df = spark.createDataFrame(rows, "id int, g int, v int")
    want = brute_rank(rows)
    got = {r["id"]: r["rk"] for r in full_rank(df, ["g"], "v", "rk", buckets=4).collect()}
    assert got == want
    top = {r["id"]: r["rk"] for r in top_k_rank(df, ["g"], "v", 10, "rk").collect()}
    assert top == {k: (v if v <= 10 else None) for k, v in want.items()}


def test_global_rank(spark):
    rnd = random.Random(7)
    rows = [(i, 0, rnd.randint(0, 40)) for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, _, v in rows], "id int, v int")
    want = brute_rank(rows)
    got = {r["id"]: r["rk"] for r in full_rank(df, [], "v", "rk", buckets=8).collect()}
    assert got == want
    top = {r["id"]: r["rk"] for r in top_k_rank(df, [], "v", 10, "rk").collect()}
    assert top == {k: (v if v <= 10 else None) for k, v in want.items()}
