"""Uniform shuffle into shards of exact size (hypergeometric communication matrix).

The rows are written once; a file's slices of ``block_rows`` rows are the source blocks. How
many rows of a block go to each shard follows the multivariate hypergeometric law given that
shard sizes differ by one row at most. The matrix (blocks x shards) is never held: it is
defined by halving the range of blocks, and a task draws only the path to its own block, each
draw from a generator seeded by the range. Within a block the shard labels are permuted; after
the exchange each shard is permuted again by random keys, in buckets of a key range, so that
neither a hot source nor a shard is one task.

Law: ``rows``. Equal texts are not kept together (with exact sizes they cannot be).
Nulls, empty and long texts and repeated rows are just values here; an empty table gives an empty
result. An input column called shard or slot (in any case) comes back as shard_0, slot_0, or with
the next number that is free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: numpy's hypergeometric law takes populations below this.
_POPULATION = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of good + bad, exact for any population: beyond numpy's limit
    every one is drawn with a fixed chance (two binomials) and the surplus is put back, or the
    lack drawn, one by one (about the square root of the population)."""
    n = good + bad
    if n < _POPULATION:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    g, b = int(rng.binomial(good, draws / n)), int(rng.binomial(bad, draws / n))
    while g + b > draws:
        g, b = (g - 1, b) if rng.random() * (g + b) < g else (g, b - 1)
    while g + b < draws:
        left = good - g
        g, b = (g + 1, b) if rng.random() * (n - g - b) < left else (g, b + 1)
    return g


def split_counts(rng: np.random.Generator, caps: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw: how many of each colour are among ``draws``."""
    out, rest = np.zeros(len(caps), np.int64), int(caps.sum())
    for i, c in enumerate(caps.tolist()):
        if not draws:
            break
        rest -= c
        out[i] = hypergeometric(rng, c, rest, draws)
        draws -= int(out[i])
    return out


def block_counts(seed: int, edges: np.ndarray, caps: np.ndarray, block: int) -> np.ndarray:
    """Row ``block`` of the communication matrix; ``edges``: rows before each block."""
    lo, hi = 0, len(edges) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_counts(np.random.default_rng([seed, 1, lo, hi]), caps, int(edges[mid] - edges[lo]))
        caps, lo, hi = (left, lo, mid) if block < mid else (caps - left, mid, hi)
    return caps


def free_names(names: list[str], taken: tuple[str, ...]) -> list[str]:
    """``names``, those that are ``taken`` with the first number that makes them free."""
    used, out = {*taken, *(n.lower() for n in names)}, []
    for name in names:
        if name.lower() in taken:
            name = next(f"{name}_{i}" for i in range(len(used) + 1) if f"{name}_{i}".lower() not in used)
            used.add(name.lower())
        out.append(name)
    return out


def shard_rows(df: DataFrame, n_shards: int = 16, seed: int = 20240601,
               block_rows: int = 1 << 16, bucket_rows: int = 1 << 14) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 within its shard) behind
    its columns. What the driver gathers is one count per source block: rows / block_rows, and
    one per input task at least."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    names = df.columns
    held = scratch.stage(df.toDF(*[f"v{i}" for i in range(len(names))]), "shard_rows")
    at = held.select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    blocks = sorted((r.f, r.b, r.n) for r in at.groupBy("f", F.expr(f"i div {block_rows}").alias("b")).agg(F.count("*").alias("n")).collect())
    edges = np.concatenate([[0], np.cumsum([n for _, _, n in blocks], dtype=np.int64)]) if blocks else np.zeros(1, np.int64)
    total = int(edges[-1])
    caps = total // n_shards + (np.arange(n_shards) < total % n_shards).astype(np.int64)
    known = spark.sparkContext.broadcast(({(f, b): k for k, (f, b, _) in enumerate(blocks)}, edges))

    def deal(batches):
        index, edges = known.value
        last: tuple = (None, None, None)
        for batch in batches:
            f = batch.column(batch.schema.get_field_index("f")).to_pylist()
            i = batch.column(batch.schema.get_field_index("i")).to_numpy()
            b = i // block_rows
            shard, key = np.empty(len(i), np.int32), np.empty(len(i), np.int64)
            cuts = [0, *(k for k in range(1, len(f)) if f[k] != f[k - 1] or b[k] != b[k - 1]), len(f)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                k = index[f[lo], int(b[lo])]
                if last[0] != k:
                    rng = np.random.default_rng([seed, 2, k])
                    labels = np.repeat(np.arange(n_shards, dtype=np.int32), block_counts(seed, edges, caps, k))
                    last = (k, rng.permutation(labels), rng.integers(0, 1 << 62, len(labels)))
                pos = i[lo:hi] - b[lo] * block_rows
                shard[lo:hi], key[lo:hi] = last[1][pos], last[2][pos]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(key)],
                                             names=[*batch.schema.names, "shard", "key"])

    schema = T.StructType([*at.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("key", T.LongType())])
    bits = max(0, (max(total, 1) // (n_shards * bucket_rows)).bit_length())
    dealt = scratch.stage(at.mapInArrow(deal, schema).withColumn("bucket", F.shiftright("key", 62 - bits)), "dealt_rows")
    scratch.drop(held)
    starts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "f", "i"))
    out = dealt.withColumn("rank", rank).join(starts, ["shard", "bucket"])
    return out.select(*[F.col(f"v{i}").alias(c) for i, c in enumerate(free_names(names, ("shard", "slot")))], "shard",
                      (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
