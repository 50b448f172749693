"""Exact-integer money: cents and hundredths of a percent, back to the values that
NUMERIC(10,2) arithmetic produces.

A NUMERIC(p,2) value converted to DOUBLE is the correctly rounded quotient
``unscaled / 100``; so is ``cast(cents as double) / 100.0``. Sums of cents are exact, so
``money(sum(cents))`` equals ``CAST(SUM(numeric) AS DOUBLE)`` bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(cents: Column) -> Column:
    """Integer cents -> DOUBLE amount."""
    return cents.cast("double") / F.lit(100.0)


def percent(hundredths: Column) -> Column:
    """Integer hundredths of a percent -> DOUBLE percent."""
    return hundredths.cast("double") / F.lit(100.0)


def exact_avg(cents: Column) -> Column:
    """AVG of a NUMERIC(.,2) column as DOUBLE: exact sum, then one division by the count
    of non-NULL values (independent of row order)."""
    return money(F.sum(cents)) / F.count(cents)


def micros(amount: Column) -> Column:
    """A DOUBLE price already rounded to 6 decimals -> exact integer millionths."""
    return F.round(amount * F.lit(1_000_000.0)).cast("bigint")


def from_micros(m: Column) -> Column:
    return m.cast("double") / F.lit(1_000_000.0)


def round2_from_micros(col_name: str) -> Column:
    """ROUND(x, 2) half away from zero of an exact millionths column -> DOUBLE."""
    m = F.col(col_name)
    cents = (F.when(m >= 0, F.expr(f"div({col_name} + 5000, 10000)"))
             .otherwise(-F.expr(f"div(-{col_name} + 5000, 10000)")))
    return money(cents)
