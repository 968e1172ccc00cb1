"""Cohort retention from a stored state of week masks.

Per month the state keeps, for each buyer, the weeks with a purchase as bits of masks (a row per buyer and
60 weeks: masks stay positive, so that no negation overflows). Months are loaded or replaced one by one; a week that two months share has its bit
in both. Reading unites a buyer's masks with ``bit_or``, so the matrix needs neither the events nor a
set of weeks: the first week is the lowest bit, and every other bit an offset to it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clickweave.functions.numeric import pct
from clickweave.schema import EventNames
from clickweave.sources.tables import MONTH, drop_months

#: Week 0 begins on this Monday; the weeks before it have negative numbers.
ORIGIN = dt.date(1970, 1, 5)
BITS = 60


def week_number(day: Column) -> Column:
    """Whole weeks from ORIGIN to the Monday of ``day``."""
    return F.floor(F.datediff(day, F.lit(ORIGIN)) / 7).cast("int")


def buyer_masks(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Per month, buyer and 60 weeks: the mask of weeks with a purchase."""
    bought = clean.where(F.col("event_type") == names.purchase).select(MONTH, "user_id", week_number(F.col("event_date")).alias("week"))
    slot = F.floor(F.col("week") / BITS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("week") - slot * BITS)
    return bought.groupBy(MONTH, "user_id", slot.alias("slot")).agg(F.bit_or(bit).alias("mask"))


def store_masks(clean: DataFrame, path: str, months: Iterable | None = None, names: EventNames = EventNames()) -> None:
    """Write the masks of ``months`` (all: None) of the clean table; other months of the state stay."""
    if months is not None:
        months = list(months)
        clean = clean.where(F.col(MONTH).isin(months))
    buyer_masks(clean, names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    if months is not None:
        left = {r[0] for r in clean.where(F.col("event_type") == names.purchase).select(MONTH).distinct().collect()}
        drop_months(clean.sparkSession, path, [m for m in months if m not in left])


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def activity(state: DataFrame) -> DataFrame:
    """Active buyers per cohort week and week offset. One shuffle by buyer serves the union of the masks
    and the first week; a buyer has a row per month and 60 weeks."""
    mask = F.col("mask")
    lowest = F.bit_count(mask.bitwiseAND(-mask) - 1)  # zeros below the lowest bit
    per_buyer = state.repartition("user_id").groupBy("user_id", "slot").agg(F.bit_or("mask").alias("mask"))
    first = F.min(F.col("slot") * BITS + lowest).over(Window.partitionBy("user_id"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("getbit", mask, b) == 1)
    weeks = per_buyer.withColumn("first", first).select("first", F.explode(F.transform(bits, lambda b: F.col("slot") * BITS + b)).alias("week"))
    active = weeks.groupBy("first", (F.col("week") - F.col("first")).alias("week_number")).agg(F.count(F.lit(1)).alias("active_users"))
    return active.select(F.date_add(F.lit(ORIGIN), F.col("first") * 7).alias("cohort_week"), "week_number", "active_users")


def retention(state: DataFrame, weeks: int = 13) -> DataFrame:
    """The matrix of :func:`clickweave.operators.cohort.cohort_retention`, from the state."""
    at = lambda k: F.max(F.when(F.col("week_number") == k, F.col("active_users")))
    rows = activity(state).groupBy("cohort_week").agg(at(0).alias("cohort_users"), *[at(k).alias(f"_a{k}") for k in range(1, weeks + 1)])
    return rows.select("cohort_week", "cohort_users", F.lit(100.0).alias("w0"),
                       *[pct(F.col(f"_a{k}"), F.col("cohort_users")).alias(f"w{k}") for k in range(1, weeks + 1)])
