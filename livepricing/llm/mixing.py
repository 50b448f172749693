"""Mixing sources to target weights (Sainte-Lague apportionment); DataFrame functions only.

The documents of a source, in seeded hash order, form one line of words that is cut into blocks
of ``block_tokens`` words (the last may be shorter). The words that the mix takes are
apportioned in blocks: seats go to the sources by highest quotients target / (2 s + 1). A source
with as many seats as blocks or more takes every block, and the rest of its seats go to blocks
in a seeded order; a block is taken twice at most. Seats are dealt to the shards in turn
(``shard_quotas``), so each shard has integer quotas that differ by one at most.

Sizes are counted per document; a running sum over a hot source is split into buckets of the
hash order whose totals are summed first. A null or empty text has size 0 and is never taken; a
null source is a source of its own, last in order; repeated rows each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, row_key

#: Sources in code point order take these weights in turn.
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
#: A block's place in the seeded order is prime * block modulo the blocks, with the
#: first of these primes that does not divide their number (products fit a long up to 2^43 blocks).
PRIMES = (1000003, 1000033, 999983)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sized: DataFrame, share: float = 1.5, most: int = 2, block_tokens: int = 32) -> DataFrame:
    """Per source: source_size, target, blocks (of the source), quota (blocks to take) and
    first_seat. ``sized``: source, size.

    Targets: a common factor times the weight, or ``most`` times the source's size where that is
    less; the factor is found by one running sum over the sources in order of cap per weight.
    Quotas: only seats whose number lies near the proportional share are ranked; every seat
    below that band is won and every seat above it lost (rounding shifts the divisor by less
    than half a seat per source). The windows without a key run over one row per source."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("ord", F.row_number().over(by_source))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("ord") - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most))
    everything, by_cap = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "ord")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("want", F.sum("source_size").over(everything) * share)
    s = s.withColumn("factor", (F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source in this order whose cap holds its share fixes the factor for it and all later ones
    s = s.withColumn("factor", F.min(F.when(F.col("factor") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "ord", "factor"))).over(everything)["factor"])
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("factor") * F.col("weight"), F.col("cap"))))
    s = s.withColumn("blocks", F.expr(f"(source_size + {block_tokens - 1}) div {block_tokens}"))
    s = s.withColumn("seats", F.floor(F.sum("target").over(everything) / block_tokens + 0.5))
    share_of = F.col("target") / block_tokens
    band = F.ceil(share_of * F.count("*").over(everything) / (2 * F.greatest("seats", F.lit(1)))) + 1
    s = s.withColumn("low", F.greatest(F.floor(share_of) - band, F.lit(0))).withColumn("high", F.floor(share_of) + band + 1)
    tried = s.select("ord", "target", "seats", "low", F.explode(F.expr("sequence(low, high)")).alias("k"))
    lows = s.groupBy().agg(F.sum("low").alias("sure"))
    rank = F.row_number().over(Window.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "ord", "k"))
    won = tried.withColumn("rank", rank).where((F.col("rank") <= F.col("seats") - lows.scalar()) & (F.col("target") > 0))
    s = s.join(won.groupBy("ord").agg(F.count("*").alias("won")), "ord", "left")
    s = s.withColumn("quota", F.least(F.col("low") + F.coalesce("won", F.lit(0)), most * F.col("blocks")))
    s = s.withColumn("first_seat", F.sum("quota").over(Window.orderBy("ord")) - F.col("quota"))
    return s.select("source", "source_size", "target", "blocks", "quota", "first_seat", "ord")


def shard_quotas(plan: DataFrame, n_shards: int = 16) -> DataFrame:
    """source, shard, quota: seat number modulo the shards gives the shard."""
    end = F.col("first_seat") + F.col("quota")
    upto = lambda x: F.expr(f"({x} + {n_shards - 1} - shard) div {n_shards}")  # noqa: E731  seats below x of this shard
    return (plan.withColumn("end", end).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
            .select("source", "shard", (upto("end") - upto("first_seat")).alias("quota")))


def mix(df: DataFrame, share: float = 1.5, block_tokens: int = 32, seed: int = 7, bucket_rows: int = 1 << 14) -> DataFrame:
    """Per row of ``df`` (doc_id, text, source): doc_id, row_key, source, size, source_size, target, taken."""
    scratch = Scratch(df.sparkSession)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = scratch.stage(df.select("doc_id", row_key().alias("row_key"), "source", word_count(F.col("text")).alias("size"), order.alias("h")), "mix_sizes")
    digits = max(1, -(-(max(sized.count(), 1) // bucket_rows).bit_length() // 4))
    plan = scratch.stage(source_plan(sized.select("source", "size"), share, block_tokens=block_tokens), "mix_plan")
    sized = sized.withColumn("bucket", F.substring("h", 1, digits))
    starts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select(
        F.col("source").alias("s1"), F.col("bucket").alias("b1"),
        (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = sized.withColumn("upto", F.sum("size").over(within))
    d = d.join(starts, F.col("source").eqNullSafe(F.col("s1")) & (F.col("bucket") == F.col("b1"))).drop("s1", "b1")
    p = plan.select(F.col("source").alias("s2"), "source_size", "target", "blocks", "quota")
    d = d.join(p, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    d = d.withColumn("end", F.col("base") + F.col("upto")).withColumn("start", F.col("end") - F.col("size"))
    taken = F.expr(f"""aggregate(sequence(start div {block_tokens}, (end - 1) div {block_tokens}), 0L, (a, b) -> a
        + (least((b + 1) * {block_tokens}, end) - greatest(b * {block_tokens}, start))
        * (quota div blocks + if((prime * b + {seed}) % blocks < quota % blocks, 1, 0)))""")
    a, b, c = PRIMES
    d = d.withColumn("prime", F.expr(f"if(blocks % {a} <> 0, {a}L, if(blocks % {b} <> 0, {b}L, {c}L))"))
    return d.select("doc_id", "row_key", "source", "size", "source_size", "target",
                    F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that the mix takes, twice where it takes them twice: a row comes as
    often as the words taken of it, rounded to whole texts (halves up). Equal rows share what is
    taken of them all."""
    m = mix(df, **options)
    times = F.expr("if(size > 0, (2 * taken + size) div (2 * size), 0)")
    m = m.groupBy("row_key").agg(F.sum(times).alias("times"), F.count("*").alias("rows"))
    rows = df.select(F.struct("*").alias("row"), row_key().alias("row_key")).join(m.where("times > 0"), "row_key")
    n = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    rows = rows.withColumn("n", F.expr("times div rows") + F.when(n <= F.col("times") % F.col("rows"), 1).otherwise(0))
    return rows.where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")


#: The same mix in DuckDB SQL (share 1.5, blocks of 32 words, seed 7), seats ranked in full.
MIX_SQL = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                      md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((ord - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM src),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY cap / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM w),
fixed AS (SELECT arg_min(factor, (cap / weight, ord)) AS factor FROM f WHERE factor * weight <= cap),
t AS (SELECT f.source, f.source_size, f.ord, least(cap, coalesce(fixed.factor * weight, cap))::DOUBLE AS target, (f.source_size + 31) // 32 AS blocks FROM f, fixed),
b AS (SELECT floor(sum(target) / 32 + 0.5)::BIGINT AS seats FROM t),
q AS (SELECT ord, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, ord, k) AS rank
      FROM (SELECT ord, target, unnest(range(0, 2 * blocks + 2)) AS k FROM t WHERE target > 0)),
won AS (SELECT ord, count(*) AS won FROM q, b WHERE rank <= seats GROUP BY ord),
plan AS (SELECT t.*, least(coalesce(won, 0), 2 * blocks) AS quota FROM t LEFT JOIN won USING (ord)),
line AS (SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS stop FROM sized)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range((stop - size) // 32, (stop - 1) // 32 + 1),
            lambda b: (least((b + 1) * 32, stop) - greatest(b * 32, stop - size))
                * (quota // blocks + CASE WHEN (CASE WHEN blocks % 1000003 <> 0 THEN 1000003 WHEN blocks % 1000033 <> 0 THEN 1000033 ELSE 999983 END * b + 7) % blocks < quota % blocks THEN 1 ELSE 0 END))) END::BIGINT AS taken
FROM line JOIN plan ON line.source IS NOT DISTINCT FROM plan.source
"""
