"""Derived event columns: time dimensions, category, brand and price bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from clickweave.schema import PRICE_BOUNDS, UNKNOWN


def time_dims(ts: Column) -> dict[str, Column]:
    """UTC date, first day of month (DATE), hour and English weekday name."""
    d = F.to_date(ts)
    return {
        "event_date": d,
        "event_month": F.trunc(d, "MM"),
        "event_hour": F.hour(ts),
        "event_day_of_week": F.date_format(d, "EEEE"),
    }


def category_top(code: Column) -> Column:
    """Text before the first dot; 'unknown' when the code is NULL. '' stays ''."""
    return F.coalesce(F.split_part(code, F.lit("."), F.lit(1)), F.lit(UNKNOWN))


def category_depth(code: Column) -> Column:
    """Number of dot-separated levels (split takes a regex, hence the class)."""
    return F.size(F.split(code, "[.]"))


def brand_norm(brand: Column) -> Column:
    return F.coalesce(F.lower(brand), F.lit(UNKNOWN))


def price_bucket_labels(bounds: Sequence[float] = PRICE_BOUNDS) -> list[str]:
    lows = [0, *bounds[:-1]]
    return [f"{lo:g}-{hi:g}" for lo, hi in zip(lows, bounds)] + [f"{bounds[-1]:g}+"]


def price_bucket(price: Column, bounds: Sequence[float] = PRICE_BOUNDS) -> Column:
    """Half-open buckets [lo, hi); negatives fall in the first, NULL is 'unknown'."""
    labels = price_bucket_labels(bounds)
    expr = F.when(price.isNull(), F.lit(UNKNOWN))
    for hi, label in zip(bounds, labels):
        expr = expr.when(price < F.lit(hi), F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))
