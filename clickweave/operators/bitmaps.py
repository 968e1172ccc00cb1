"""Exact distinct users that add up: dense user numbers and a stored table of bitmaps.

The sum of stored buyers over product groups counts a buyer once per group. Here each known user has
a number without gaps (a dictionary that only grows), and per month, category, brand and price bucket
the store keeps bitmaps of users, viewers, carters and buyers, cut into slices of 32,768 numbers. A
roll-up is the union of stored bitmaps per slice, counted, and summed over the slices: exact, and
without a look at the events. A slice's bitmap is 4 KB at most, whatever the number of its users, so
no row grows with the data and a large group is as many rows as there are slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from clickweave.functions.numbering import extend_ids
from clickweave.operators.product import PRODUCT_KEYS, product_events
from clickweave.schema import EventNames
from clickweave.sources.tables import MONTH, drop_months

ROLES = ("users", "viewers", "carters", "purchasers")


def product_bitmaps(clean: DataFrame, numbers: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Per product group and slice of user numbers: one bitmap per role. Events are reduced to a row per
    group and user, with a partial aggregate, before users meet their numbers."""
    t = F.col("event_type")
    flags = [F.max(F.when(t == kind, 1)).alias(role) for role, kind in zip(ROLES[1:], names.all)]
    per_user = product_events(clean).groupBy(*PRODUCT_KEYS, "user_id").agg(*flags).withColumn("users", F.lit(1))
    place = F.col("uid") + 1  # Spark's bitmaps number bits from 1
    return (per_user.join(numbers, "user_id").groupBy(*PRODUCT_KEYS, F.bitmap_bucket_number(place).alias("slice"))
            .agg(*[F.bitmap_construct_agg(F.when(F.col(r) == 1, F.bitmap_bit_position(place))).alias(r) for r in ROLES]))


def store_bitmaps(clean: DataFrame, path: str, numbers_path: str, months: Iterable | None = None, names: EventNames = EventNames()) -> None:
    """Write the bitmaps of ``months`` (all: None) of the clean table, after giving numbers to new users."""
    if months is not None:
        months = list(months)
        clean = clean.where(F.col(MONTH).isin(months))
    known = product_events(clean)
    numbers = extend_ids(clean.sparkSession, numbers_path, known.select("user_id"))
    (product_bitmaps(clean, numbers, names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path))
    if months is not None:
        left = {r[0] for r in known.select(MONTH).distinct().collect()}
        drop_months(clean.sparkSession, path, [m for m in months if m not in left])


def distinct_rollup(store: DataFrame, grains: Sequence[Sequence[str]]) -> DataFrame:
    """Exact distinct users by role for each grain (a list of product keys; empty: everything), keys that a
    grain lacks being NULL, with ``grain`` naming its keys."""
    keys = [k for k in PRODUCT_KEYS if any(k in g for g in grains)]
    sets = [[*g, "slice"] for g in grains]
    merged = store.groupingSets(sets, *keys, "slice").agg(
        F.grouping_id().alias("gid"), *[F.bitmap_or_agg(r).alias(r) for r in ROLES])
    ids = {sum(1 << (len(keys) - i) for i, k in enumerate(keys) if k not in g): "_".join(g) or "total" for g in grains}
    name = F.coalesce(*[F.when(F.col("gid") == i, F.lit(n)) for i, n in ids.items()])
    return merged.groupBy(name.alias("grain"), *keys).agg(*[F.sum(F.bitmap_count(r)).alias(r) for r in ROLES])
