"""Rounding and ratio helpers.

Rounding goes through DECIMAL(38,10) then HALF_UP, so that a mean landing on
x.xx5 rounds the same way whatever engine or summation order produced it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EXACT = "decimal(38,10)"


def round_n(c: Column, n: int) -> Column:
    """ROUND(c, n) as double, with decimal half-up semantics."""
    return F.round(c.cast(_EXACT), n).cast("double")


def money(c: Column) -> Column:
    """Exact, order-independent representation of a price for summation."""
    return c.cast(_EXACT)


def safe_ratio(num: Column, den: Column, scale: float = 100.0) -> Column:
    """num * scale / den, NULL when den is 0 or NULL (never raises under ANSI)."""
    return (num * F.lit(float(scale))) / F.nullif(den, F.lit(0))


def pct(num: Column, den: Column, n: int = 2) -> Column:
    """Percentage rounded to n places; NULL on a zero denominator."""
    return round_n(safe_ratio(num, den), n)
