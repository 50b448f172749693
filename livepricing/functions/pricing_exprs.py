"""Column expressions of the pricing formula (all JVM-side built-ins).

Each expression is written as Spark SQL text over column names and handed to the JVM in
one call (``F.expr``); building the same trees Column by Column costs a Py4J round trip
per node, which dominated driver-side planning time.
"""

from __future__ import annotations

from ..sources.model import RANK_NEAR, RANK_TOP

# Fixed values that must equal the reference's for the same results.
POPULARITY_TOP, POPULARITY_NEAR, POPULARITY_REST = 1.2, 1.1, 0.9
STOCK_TOP, STOCK_NEAR, STOCK_REST = 1.1, 1.05, 1.0
KEYWORD_DISCOUNT, NO_DISCOUNT = 0.8, 1.0
PRICE_DIGITS = 6   # our numeric contract: prices are rounded to 1e-6


def _d(x: float) -> str:
    """A DOUBLE literal in Spark SQL."""
    return f"CAST({x!r} AS DOUBLE)"


def band_sql(rank: str, top: float, near: float, rest: float) -> str:
    """rank <= 3 -> top, 4..10 -> near, anything else (including NULL) -> rest."""
    return (f"CASE WHEN `{rank}` <= {RANK_TOP} THEN {_d(top)} "
            f"WHEN `{rank}` BETWEEN {RANK_TOP + 1} AND {RANK_NEAR} THEN {_d(near)} "
            f"ELSE {_d(rest)} END")


def popularity_sql(rank: str) -> str:
    return band_sql(rank, POPULARITY_TOP, POPULARITY_NEAR, POPULARITY_REST)


def stock_sql(rank: str) -> str:
    return band_sql(rank, STOCK_TOP, STOCK_NEAR, STOCK_REST)


def promotion_sql(discount_hundredths: str) -> str:
    """1 - d/100 of the smallest active discount (d in percent, stored in hundredths of a
    percent), 1 when there is none."""
    return (f"COALESCE(CAST(1.0 AS DOUBLE) - (CAST(`{discount_hundredths}` AS DOUBLE) / 100.0) / 100.0, "
            f"CAST(1.0 AS DOUBLE))")


def demand_sql(base: str, avg: str) -> str:
    """Two-branch ratio of base price to recent average price (equal to base/avg)."""
    b, a = f"({base})", f"`{avg}`"
    return (f"CASE WHEN {b} > {a} THEN CAST(1.0 AS DOUBLE) + ({b} - {a}) / {a} "
            f"ELSE CAST(1.0 AS DOUBLE) - ({a} - {b}) / {a} END")


def name_discount_sql(name: str, keyword: str) -> str:
    kw = keyword.replace("\\", "\\\\").replace("'", "\\'")
    return f"CASE WHEN `{name}` ILIKE '%{kw}%' THEN {_d(KEYWORD_DISCOUNT)} ELSE {_d(NO_DISCOUNT)} END"


def adjusted_price_sql(base: str, *factors: str) -> str:
    """Left-to-right product in DOUBLE, rounded to the price contract."""
    product = "(" + base + ")"
    for f in factors:
        product = f"({product} * `{f}`)"
    return f"ROUND({product}, {PRICE_DIGITS})"
