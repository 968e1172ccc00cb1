"""A stored table of mergeable sketches per product group.

Stored distinct counts do not add up over groups; sketches do. Per month, category, brand and price
bucket the store keeps an HLL sketch of all users and theta sketches of viewers, carters and buyers.
Any roll-up is a union of stored sketches, and a funnel step an intersection of two of them, without
a look at the events. The store is partitioned by month; a month is replaced as a whole.

Estimates: with ``lg_k`` = 14 an HLL estimate is within 2 %, and a theta estimate within 2.4 %, of the
truth three times out of their standard error; an intersection's error is a share of the union of
both sets. Sets of under 2 ** 14 users are counted exactly by theta sketches.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickweave.operators.product import PRODUCT_KEYS, product_events
from clickweave.schema import EventNames
from clickweave.sources.tables import MONTH, drop_months

LG_K = 14
#: The stages whose users have a theta sketch, in order.
STAGES = ("viewers", "carters", "purchasers")


def product_sketches(clean: DataFrame, names: EventNames = EventNames(), lg_k: int = LG_K) -> DataFrame:
    """Per product group: an HLL sketch of its users and theta sketches of viewers, carters and buyers."""
    t = F.col("event_type")
    return product_events(clean).groupBy(*PRODUCT_KEYS).agg(
        F.hll_sketch_agg("user_id", lg_k).alias("users_sketch"),
        *[F.theta_sketch_agg(F.when(t == kind, F.col("user_id")), lg_k).alias(f"{stage}_sketch") for stage, kind in zip(STAGES, names.all)])


def store_sketches(clean: DataFrame, path: str, months: Iterable | None = None, names: EventNames = EventNames(), lg_k: int = LG_K) -> None:
    """Write the sketches of ``months`` (all: None) of the clean table; other months of the store stay, and a
    month that has no groups any more is removed."""
    if months is not None:
        months = list(months)
        clean = clean.where(F.col(MONTH).isin(months))
    (product_sketches(clean, names, lg_k).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path))
    if months is not None:
        left = {r[0] for r in product_events(clean).select(MONTH).distinct().collect()}
        drop_months(clean.sparkSession, path, [m for m in months if m not in left])


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rollup_sketches(store: DataFrame, keys: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """Estimates at a coarser grain: distinct users and users by stage."""
    merged = store.groupBy(*keys).agg(
        F.hll_union_agg("users_sketch", True).alias("users"), *[F.theta_union_agg(f"{s}_sketch", lg_k).alias(s) for s in STAGES])
    return merged.select(*keys, F.hll_sketch_estimate("users").alias("est_users"), *[F.theta_sketch_estimate(s).alias(f"est_{s}") for s in STAGES])


def funnel_overlaps(store: DataFrame, keys: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """Estimates at a coarser grain of users who did both: view and cart, cart and buy, view and buy; and of
    buyers who never put anything into a cart."""
    merged = store.groupBy(*keys).agg(*[F.theta_union_agg(f"{s}_sketch", lg_k).alias(s) for s in STAGES])
    both = lambda a, b: F.theta_sketch_estimate(F.theta_intersection(a, b))
    return merged.select(
        *keys, both("viewers", "carters").alias("est_viewed_carted"), both("carters", "purchasers").alias("est_carted_bought"),
        both("viewers", "purchasers").alias("est_viewed_bought"),
        F.theta_sketch_estimate(F.theta_difference("purchasers", "carters")).alias("est_bought_uncarted"))


def _near(exact: str, of: str, within: float) -> F.Column:
    return (F.abs(F.col(f"est_{exact}") - F.col(exact)) <= within * F.col(of)).alias(f"{exact}_near")


def sketch_accuracy(clean: DataFrame, store: DataFrame, keys: list[str], names: EventNames = EventNames(), within: float = 0.05) -> DataFrame:
    """Per roll-up group: exact distinct users, viewers and purchasers from the events, and whether what
    the store says is within that share of them."""
    t = F.col("event_type")
    exact = product_events(clean).groupBy(*keys).agg(
        F.countDistinct("user_id").alias("users"),
        F.countDistinct(F.when(t == names.view, F.col("user_id"))).alias("viewers"),
        F.countDistinct(F.when(t == names.purchase, F.col("user_id"))).alias("purchasers"))
    both = exact.join(rollup_sketches(store, keys), keys)
    counted = ("users", "viewers", "purchasers")
    return both.select(*keys, *counted, *[_near(c, c, within) for c in counted])


def overlap_accuracy(clean: DataFrame, store: DataFrame, keys: list[str], names: EventNames = EventNames(), within: float = 0.05) -> DataFrame:
    """Per roll-up group: exact funnel overlaps from the events, and whether what the store says is within
    that share of the group's users (the union that an intersection's error is a share of)."""
    t = F.col("event_type")
    did = lambda kind: F.max(F.when(t == kind, 1).otherwise(0)) == 1
    users = product_events(clean).groupBy(*keys, "user_id").agg(did(names.view).alias("v"), did(names.cart).alias("c"), did(names.purchase).alias("p"))
    counted = {"viewed_carted": "v and c", "carted_bought": "c and p", "viewed_bought": "v and p", "bought_uncarted": "p and not c"}
    exact = users.groupBy(*keys).agg(F.count(F.lit(1)).alias("users"), *[F.count_if(F.expr(e)).alias(c) for c, e in counted.items()])
    both = exact.join(funnel_overlaps(store, keys), keys)
    return both.select(*keys, *counted, *[_near(c, "users", within) for c in counted])
