"""Product performance per month x top category x brand x price bucket.

Five distinct counts (users, products, viewers, carters, purchasers) would make Spark's
distinct rewrite expand every row six times. Instead one grouping-sets aggregate keeps a
row per (group, user) with stage flags and per (group, product), each partially
aggregated before the shuffle; a second aggregate over those rows gives all metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickweave.functions.numeric import money, pct, round_n
from clickweave.schema import UNKNOWN, EventNames

PRODUCT_KEYS = ["event_month", "category_top", "brand", "price_bucket"]
# grouping_id() over (*PRODUCT_KEYS, user_id, product_id): bit 0 = product_id, bit 1 = user_id
_USER_SET, _PRODUCT_SET = 0b01, 0b10


def product_events(clean: DataFrame) -> DataFrame:
    """Rows with a known top category and brand (a literal 'unknown' counts as unknown)."""
    return clean.where((F.col("category_top") != UNKNOWN) & (F.col("brand") != UNKNOWN))


def product_metrics(clean: DataFrame, names: EventNames = EventNames(), denominator: str = "view") -> DataFrame:
    """Events, users, products, stage users, revenue (0 when no purchase), mean purchase
    price (NULL when none) and purchasers/viewers (%) per product group (purchasers over all
    users of the group with ``denominator='any'``)."""
    is_buy = F.col("event_type") == names.purchase
    flag = lambda t: F.max(F.when(F.col("event_type") == t, 1).otherwise(0))
    level1 = (product_events(clean)
              .groupingSets([[*PRODUCT_KEYS, "user_id"], [*PRODUCT_KEYS, "product_id"]],
                            *PRODUCT_KEYS, "user_id", "product_id")
              .agg(F.count(F.lit(1)).alias("n"),
                   flag(names.view).alias("v"), flag(names.cart).alias("c"), flag(names.purchase).alias("p"),
                   F.count_if(is_buy).alias("buy_rows"),
                   # money is only needed at (group, user) grain
                   F.sum(money(F.when((F.grouping_id() == _USER_SET) & is_buy, F.col("price")))).alias("buy_sum"),
                   F.count(F.when(is_buy, F.col("price"))).alias("buy_cnt"),
                   F.grouping_id().alias("gid")))
    on_user = F.col("gid") == _USER_SET
    by_user = lambda c: F.when(on_user, F.col(c))
    level2 = level1.groupBy(*PRODUCT_KEYS).agg(
        F.sum(by_user("n")).alias("total_events"),
        F.count(by_user("user_id")).alias("unique_users"),
        F.count(F.when(F.col("gid") == _PRODUCT_SET, F.col("product_id"))).alias("unique_products"),
        F.sum(by_user("v")).cast("bigint").alias("viewers"),
        F.sum(by_user("c")).cast("bigint").alias("carters"),
        F.sum(by_user("p")).cast("bigint").alias("purchasers"),
        F.sum(by_user("buy_rows")).alias("buy_rows"), F.sum(by_user("buy_sum")).alias("buy_sum"),
        F.sum(by_user("buy_cnt")).alias("buy_cnt"))
    # SUM(CASE WHEN purchase THEN price ELSE 0 END): 0 without purchases, NULL only when every
    # row is a purchase without a price
    has_value = (F.col("total_events") > F.col("buy_rows")) | (F.col("buy_cnt") > 0)
    rev = F.when(has_value, F.coalesce(F.col("buy_sum"), F.lit(0).cast("decimal(38,10)")))
    return level2.select(
        *PRODUCT_KEYS, "total_events", "unique_users", "unique_products", "viewers", "carters", "purchasers",
        round_n(rev, 2).alias("revenue"),
        round_n(F.when(F.col("buy_cnt") > 0, F.col("buy_sum").cast("double") / F.col("buy_cnt")), 2)
        .alias("avg_order_value"),
        pct(F.col("purchasers"), F.col({"view": "viewers", "any": "unique_users"}[denominator])).alias("cvr"))
