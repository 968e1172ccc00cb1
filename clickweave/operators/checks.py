"""Consistency checks over the analytical relations, as queries returning frames.

Invariants the source model states but that do not always hold (rates within 0-100, the
Lost segment having the highest recency) are reported, never asserted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickweave.functions.numeric import money, pct, round_n
from clickweave.operators.funnel import CATEGORY, MONTHLY, OVERALL, funnel
from clickweave.schema import EventNames
from clickweave.sources.tables import MONTH


def _mean(column: str, n: int) -> Column:
    """Mean of exact sums: the same whatever order the rows came in."""
    return round_n(F.sum(money(F.col(column))) / F.nullif(F.count(column), F.lit(0)), n)


# -- funnel ---------------------------------------------------------------------------------

def check_funnel_overall(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    return funnel(clean, names, parts=[OVERALL])


def check_funnel_monthly(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Months in order."""
    return funnel(clean, names, parts=[MONTHLY]).orderBy("event_month")


def check_funnel_category(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Categories, the best conversion rate first."""
    return funnel(clean, names, parts=[CATEGORY]).select(
        "row_type", "category_top", "viewers", "purchasers", "category_cvr").orderBy(
        F.col("category_cvr").desc_nulls_last(), "category_top")


def _outside() -> Column:
    """Whether a rate of the row leaves 0-100 (possible: stage flags are independent)."""
    bad = F.lit(False)
    for r in ("view_to_cart_rate", "cart_to_purchase_rate", "overall_cvr", "category_cvr"):
        bad = bad | F.coalesce((F.col(r) < 0) | (F.col(r) > 100), F.lit(False))
    return bad


def rate_violations(funnel_df: DataFrame) -> DataFrame:
    """Rows of the funnel relation whose rates leave 0-100."""
    return funnel_df.where(_outside())


def check_funnel_rates(funnel_df: DataFrame) -> DataFrame:
    """Per part of the funnel relation: rows, and rows whose rates leave 0-100."""
    return funnel_df.groupBy("row_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(_outside()).alias("n_outside"))


# -- cohort ---------------------------------------------------------------------------------

def check_cohort(cohort_df: DataFrame) -> DataFrame:
    """The retention relation, oldest cohort first."""
    return cohort_df.orderBy("cohort_week")


def check_cohort_sizes(cohort_df: DataFrame, clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """One row: cohorts, the sum of their sizes, the buyers counted from the events, and whether the
    two agree (every buyer belongs to one cohort)."""
    sizes = cohort_df.agg(F.count(F.lit(1)).alias("cohorts"), F.coalesce(F.sum("cohort_users"), F.lit(0)).alias("cohort_users"))
    buyers = clean.where(F.col("event_type") == names.purchase).agg(F.countDistinct("user_id").alias("buyers"))
    both = sizes.withColumn("k", F.lit(1)).join(buyers.withColumn("k", F.lit(1)), "k")  # one row each
    return both.select("cohorts", "cohort_users", "buyers", (F.col("cohort_users") == F.col("buyers")).alias("sizes_match"))


# -- rfm ------------------------------------------------------------------------------------

def check_rfm_recency(rfm_df: DataFrame) -> DataFrame:
    """Per recency score: buyers and mean / min / max recency."""
    return rfm_df.groupBy("r_score").agg(
        F.count(F.lit(1)).alias("users"),
        _mean("recency_days", 0).alias("avg_recency_days"),
        F.min("recency_days").alias("min_recency"), F.max("recency_days").alias("max_recency")).orderBy("r_score")


def check_rfm_segments(rfm_df: DataFrame) -> DataFrame:
    """Per segment: buyers, share of buyers (%), mean spend, recency and frequency. The
    share is a window over the per-segment aggregate (seven rows)."""
    seg = rfm_df.groupBy("segment").agg(
        F.count(F.lit(1)).alias("user_count"),
        _mean("monetary", 2).alias("avg_spend"),
        _mean("recency_days", 0).alias("avg_recency_days"),
        _mean("frequency", 1).alias("avg_frequency"))
    share = pct(F.col("user_count"), F.sum("user_count").over(Window.partitionBy()))
    return seg.select("segment", "user_count", share.alias("pct_of_users"), "avg_spend",
                      "avg_recency_days", "avg_frequency").orderBy(F.col("user_count").desc(), "segment")


# -- product --------------------------------------------------------------------------------

def check_product_category(product_df: DataFrame, n: int = 10) -> DataFrame:
    """Top n categories by revenue: revenue, unweighted mean of group CVRs, summed group
    purchasers (a buyer counts once per group, not once overall), brands."""
    return (product_df.groupBy("category_top").agg(
                round_n(F.sum(money(F.col("revenue"))), 2).alias("total_revenue"),
                _mean("cvr", 2).alias("avg_cvr"),
                F.sum("purchasers").alias("total_purchasers"),
                F.countDistinct("brand").alias("unique_brands"))
            .orderBy(F.col("total_revenue").desc_nulls_last(), F.col("category_top").asc())
            .limit(n))


def check_product_monthly(product_df: DataFrame) -> DataFrame:
    return product_df.groupBy("event_month").agg(
        round_n(F.sum(money(F.col("revenue"))), 2).alias("monthly_revenue"),
        F.sum("purchasers").alias("monthly_purchasers"),
        _mean("cvr", 2).alias("avg_cvr")).orderBy("event_month")


def top_category(product_df: DataFrame) -> DataFrame:
    """One-row frame: the category with the highest product revenue (ties by name)."""
    return check_product_category(product_df, 1).select("category_top")


def _category_rows(df: DataFrame, category: str | DataFrame) -> DataFrame:
    if isinstance(category, DataFrame):
        return df.join(F.broadcast(category), "category_top")
    return df.where(F.col("category_top") == category)


def check_category_product(product_df: DataFrame, category: str | None = None) -> DataFrame:
    """Per month for one category: product-view revenue and brands. ``category=None``
    checks the top-revenue category."""
    cat = top_category(product_df) if category is None else category
    return (_category_rows(product_df, cat).groupBy("event_month").agg(
        round_n(F.sum(money(F.col("revenue"))), 2).alias("product_view_revenue"),
        F.countDistinct("brand").alias("brands")).orderBy("event_month"))


def check_category_clean(clean: DataFrame, product_df: DataFrame | None = None,
                         category: str | None = None, names: EventNames = EventNames()) -> DataFrame:
    """Same category per month straight from clean purchases (unknown brands included, so
    revenue is at least the product-view revenue)."""
    cat = top_category(product_df) if category is None else category
    buys = clean.where(F.col("event_type") == names.purchase)
    return (_category_rows(buys, cat).groupBy("event_month").agg(
        round_n(F.sum(money(F.col("price"))), 2).alias("raw_revenue"),
        F.countDistinct("user_id").alias("purchasers")).orderBy("event_month"))


def check_month_completeness(raw: DataFrame, month: dt.date = dt.date(2019, 12, 1)) -> DataFrame:
    """First day, last day and rows of one month of the raw table (pruned to its partition
    when the table is month-partitioned)."""
    nxt = (month.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    if MONTH in raw.columns:
        rows = raw.where(F.col(MONTH) == F.lit(month))
    else:
        day = F.to_date("event_time")
        rows = raw.where((day >= F.lit(month)) & (day < F.lit(nxt)))
    d = F.to_date("event_time")
    return rows.agg(F.min(d).alias("first_day"), F.max(d).alias("last_day"),
                    F.count(F.lit(1)).alias("total_rows"))
