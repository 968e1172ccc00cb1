"""Monthly KPIs, event-type mix and month-over-month changes.

One aggregate at (month, user) grain carries everything: distinct users per stage come
from per-user counts, the type mix from summed counts, so no join is needed. The
month-over-month window runs over the monthly rows only (one per month of the period).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clickweave.functions.numeric import money, pct, round_n, safe_ratio
from clickweave.schema import EventNames


def _month_user_totals(clean: DataFrame, names: EventNames) -> DataFrame:
    t = F.col("event_type")
    cnt = lambda name: F.count_if(t == name)
    level1 = clean.groupBy("event_month", "user_id").agg(
        F.count(F.lit(1)).alias("n"), cnt(names.view).alias("nv"), cnt(names.cart).alias("nc"),
        cnt(names.purchase).alias("np"),
        F.sum(money(F.when(t == names.purchase, F.col("price")).otherwise(F.lit(0.0)))).alias("rev"))
    return level1.groupBy("event_month").agg(
        F.sum("n").alias("total_events"), F.count(F.lit(1)).alias("unique_users"),
        F.count_if(F.col("nv") > 0).alias("viewers"), F.count_if(F.col("nc") > 0).alias("carters"),
        F.count_if(F.col("np") > 0).alias("purchasers"),
        round_n(F.sum("rev"), 2).alias("revenue"),
        F.sum("nv").alias("ve"), F.sum("nc").alias("ce"), F.sum("np").alias("pe"))


_MONTHLY = ["event_month", "total_events", "unique_users", "viewers", "carters", "purchasers", "revenue"]


def _cvr(denominator: str) -> F.Column:
    den = {"view": "viewers", "any": "unique_users"}[denominator]
    return pct(F.col("purchasers"), F.col(den)).alias("cvr")


def overview_monthly(clean: DataFrame, names: EventNames = EventNames(), denominator: str = "view") -> DataFrame:
    """Per month: events, users, viewers, carters, purchasers, revenue, CVR (purchasers over
    viewers, or over all users with ``denominator='any'``)."""
    m = _month_user_totals(clean, names)
    return m.select(*_MONTHLY, _cvr(denominator))


def overview_event_mix(clean: DataFrame) -> DataFrame:
    """Per month and event type: events and share of the month's events (%)."""
    counts = clean.groupBy("event_month", "event_type").agg(F.count(F.lit(1)).alias("event_count"))
    month_total = F.sum("event_count").over(Window.partitionBy("event_month"))
    return counts.withColumn("event_pct", pct(F.col("event_count"), month_total))


def overview(clean: DataFrame, names: EventNames = EventNames(), denominator: str = "view") -> DataFrame:
    """Monthly KPIs with the type mix as columns (NULL when a type is absent in a month)
    and changes against the previous month present (NULL for the first)."""
    m = _month_user_totals(clean, names)
    present = lambda c: F.when(F.col(c) > 0, F.col(c))
    w = Window.orderBy("event_month")
    rev, users = F.col("revenue"), F.col("unique_users")
    prev_rev, prev_users = F.lag(rev).over(w), F.lag(users).over(w)
    return m.select(
        *_MONTHLY, _cvr(denominator),
        present("ve").alias("view_events"), present("ce").alias("cart_events"),
        present("pe").alias("purchase_events"),
        pct(present("ve"), F.col("total_events")).alias("view_pct"),
        pct(present("ce"), F.col("total_events")).alias("cart_pct"),
        pct(present("pe"), F.col("total_events")).alias("purchase_pct"),
        round_n(rev - prev_rev, 2).alias("revenue_mom_delta"),
        round_n((users - prev_users).cast("double"), 0).alias("users_mom_delta"),
        round_n(safe_ratio(rev - prev_rev, prev_rev), 2).alias("revenue_mom_pct"),
        round_n(safe_ratio(users - prev_users, prev_users), 2).alias("users_mom_pct"))
