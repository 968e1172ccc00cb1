"""Weekly purchase-cohort retention.

A buyer's cohort is the Monday of their first purchase; they are active in offset k when
they buy in the week k weeks later. One aggregate per buyer collects the set of purchase
weeks (at most one entry per week of the period, whatever the buyer's volume), so the
cohort needs no join: cohort size is the activity at offset 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickweave.functions.numeric import pct
from clickweave.schema import EventNames


def _purchase_weeks(clean: DataFrame, names: EventNames) -> DataFrame:
    return (clean.where(F.col("event_type") == names.purchase)
            .select("user_id", F.trunc(F.col("event_date"), "WEEK").alias("purchase_week")))


def buyer_weeks(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Per buyer: cohort week and the set of weeks with a purchase."""
    return (_purchase_weeks(clean, names).groupBy("user_id")
            .agg(F.min("purchase_week").alias("cohort_week"),
                 F.collect_set("purchase_week").alias("weeks")))


def first_purchase(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Per buyer: the Monday of the first purchase date."""
    return (_purchase_weeks(clean, names).groupBy("user_id")
            .agg(F.min("purchase_week").alias("cohort_week")))


def user_weeks(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Distinct (buyer, purchase week)."""
    return _purchase_weeks(clean, names).distinct()


def _offsets(clean: DataFrame, names: EventNames) -> DataFrame:
    """One row per (buyer, purchase week): cohort week and week offset."""
    bw = buyer_weeks(clean, names)
    return (bw.select("cohort_week", F.explode("weeks").alias("w"))
            .select("cohort_week",
                    F.floor(F.datediff(F.col("w"), F.col("cohort_week")) / 7).cast("int").alias("week_number")))


def cohort_activity(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Active buyers per cohort week and week offset."""
    return (_offsets(clean, names).groupBy("cohort_week", "week_number")
            .agg(F.count(F.lit(1)).alias("active_users")))


def cohort_size(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Buyers per cohort week."""
    return (first_purchase(clean, names).groupBy("cohort_week")
            .agg(F.count(F.lit(1)).alias("cohort_users")))


def cohort_retention(clean: DataFrame, names: EventNames = EventNames(), weeks: int = 13) -> DataFrame:
    """Matrix: cohort_week, cohort_users, w0 = 100.0, w1..w{weeks} = % of the cohort active
    (2dp), NULL where nobody of the cohort bought in that week."""
    wn = F.col("week_number")
    # each buyer has at most one row per offset, so counting rows counts distinct buyers
    pivot = _offsets(clean, names).groupBy("cohort_week").agg(
        F.count_if(wn == 0).alias("cohort_users"),
        *[F.count_if(wn == k).alias(f"_a{k}") for k in range(1, weeks + 1)])
    return pivot.select(
        "cohort_week", "cohort_users", F.lit(100.0).alias("w0"),
        *[pct(F.nullif(F.col(f"_a{k}"), F.lit(0)), F.col("cohort_users")).alias(f"w{k}")
          for k in range(1, weeks + 1)])
