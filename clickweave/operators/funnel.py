"""User-level purchase funnel: overall stages, monthly trend, category conversion.

All three parts come from one scan: a grouping-sets aggregate at (user), (month, user)
and (category, user) grain, partially aggregated before its shuffle, then a second
aggregate over those per-user rows, then a single projection that lays the parts out
as the stacked 19-column relation (a union of filtered branches would be planned as
three scans, since Catalyst pushes each branch's filter below the shared aggregate).
A user with a huge share of the events still sends one partial row per map task and set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from clickweave.functions.numeric import money, pct, round_n, safe_ratio
from clickweave.schema import UNKNOWN, EventNames

OVERALL, MONTHLY, CATEGORY = "Q4_OVERALL", "MONTHLY_TREND", "CATEGORY_CVR"
_SETS = {OVERALL: ["user_id"], MONTHLY: ["event_month", "user_id"], CATEGORY: ["category_top", "user_id"]}
# grouping_id() bits over (event_month, category_top, user_id): 1 = grouped out
_GID = {OVERALL: 0b110, MONTHLY: 0b010, CATEGORY: 0b100}

FUNNEL_COLUMNS = [
    ("row_type", "string"), ("event_month", "date"), ("category_top", "string"),
    ("users_viewed", "bigint"), ("users_carted", "bigint"), ("users_purchased", "bigint"),
    ("view_to_cart_rate", "double"), ("cart_to_purchase_rate", "double"), ("overall_cvr", "double"),
    ("view_to_cart_dropoff", "double"), ("cart_to_purchase_dropoff", "double"),
    ("total_events", "bigint"), ("unique_users", "bigint"), ("monthly_viewers", "bigint"),
    ("monthly_purchasers", "bigint"), ("monthly_revenue", "double"),
    ("viewers", "bigint"), ("purchasers", "bigint"), ("category_cvr", "double"),
]


def _flag(event_type: str) -> F.Column:
    return F.max(F.when(F.col("event_type") == event_type, 1).otherwise(0))


def user_flags(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Per user: 0/1 has viewed, carted, purchased over the whole period (any order)."""
    return clean.groupBy("user_id").agg(
        _flag(names.view).alias("has_viewed"), _flag(names.cart).alias("has_carted"),
        _flag(names.purchase).alias("has_purchased"))


def _stage_totals(clean: DataFrame, parts: Sequence[str], names: EventNames) -> DataFrame:
    """One row per requested part and group: events, users, stage users, revenue."""
    level1 = (clean.groupingSets([_SETS[p] for p in parts], "event_month", "category_top", "user_id")
              .agg(F.count(F.lit(1)).alias("n"),
                   _flag(names.view).alias("v"), _flag(names.cart).alias("c"),
                   _flag(names.purchase).alias("p"),
                   # revenue is only reported per month: other sets skip the decimal sum
                   F.sum(money(F.when(F.grouping_id() != _GID[MONTHLY], F.lit(None))
                               .when(F.col("event_type") == names.purchase, F.col("price"))
                               .otherwise(F.lit(0.0)))).alias("rev"),
                   F.grouping_id().alias("gid")))
    return level1.groupBy("gid", "event_month", "category_top").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("users"),
        F.sum("v").cast("bigint").alias("viewers"), F.sum("c").cast("bigint").alias("carters"),
        F.sum("p").cast("bigint").alias("purchasers"), F.sum("rev").alias("revenue"))


def _overall_cols(t: DataFrame) -> dict[str, F.Column]:
    v, c, p = F.col("viewers"), F.col("carters"), F.col("purchasers")
    return {
        "users_viewed": v, "users_carted": c, "users_purchased": p,
        "view_to_cart_rate": pct(c, v), "cart_to_purchase_rate": pct(p, c), "overall_cvr": pct(p, v),
        "view_to_cart_dropoff": round_n(F.lit(100.0) - safe_ratio(c, v), 2),
        "cart_to_purchase_dropoff": round_n(F.lit(100.0) - safe_ratio(p, c), 2),
    }


def _monthly_cols(t: DataFrame) -> dict[str, F.Column]:
    return {
        "event_month": F.col("event_month"), "total_events": F.col("events"),
        "unique_users": F.col("users"), "monthly_viewers": F.col("viewers"),
        "monthly_purchasers": F.col("purchasers"), "monthly_revenue": round_n(F.col("revenue"), 2),
    }


def _category_cols(t: DataFrame, denominator: str = "any") -> dict[str, F.Column]:
    """``viewers`` is the CVR denominator: users with any event in the category (the source
    model's SQL), or with ``denominator='view'`` users who viewed in it."""
    den = F.col({"any": "users", "view": "viewers"}[denominator])
    return {
        "category_top": F.col("category_top"), "viewers": den, "purchasers": F.col("purchasers"),
        "category_cvr": pct(F.col("purchasers"), den),
    }


_PART_COLS = {OVERALL: _overall_cols, MONTHLY: _monthly_cols, CATEGORY: _category_cols}


def _shape(totals: DataFrame, parts: Sequence[str], names: Sequence[str] | None = None,
           category_denominator: str = "any") -> DataFrame:
    """Turn the per-part totals into output rows with one projection (no union): each
    column takes its value from the part the row belongs to and is NULL elsewhere."""
    gid = F.col("gid")
    keep = ~((gid == _GID[CATEGORY]) & (F.col("category_top") == UNKNOWN))
    cols = {}
    for part in parts:
        build = _PART_COLS[part]
        part_cols = build(totals, category_denominator) if part == CATEGORY else build(totals)
        for name, expr in part_cols.items():
            cols.setdefault(name, []).append((gid == _GID[part], expr))
    row_type = None
    for part in parts:
        row_type = (F.when if row_type is None else row_type.when)(gid == _GID[part], F.lit(part))
    out = []
    for name, t in FUNNEL_COLUMNS:
        if name == "row_type":
            out.append(row_type.alias(name))
            continue
        expr = None
        for cond, value in cols.get(name, []):
            expr = (F.when if expr is None else expr.when)(cond, value)
        out.append((expr if expr is not None else F.lit(None)).cast(t).alias(name))
    shaped = totals.where(keep).select(*out)
    return shaped.select(*names) if names else shaped


def _part(clean: DataFrame, part: str, names: EventNames, category_denominator: str = "any") -> DataFrame:
    return _shape(_stage_totals(clean, [part], names), [part], list(_PART_COLS[part](clean)),
                  category_denominator)


def funnel_overall(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Users per stage, step rates, overall CVR and drop-offs (%, 2dp, NULL on 0)."""
    return _part(clean, OVERALL, names)


def funnel_monthly_trend(clean: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Per month: events, users, viewers, purchasers and purchase revenue."""
    return _part(clean, MONTHLY, names)


def funnel_category_cvr(clean: DataFrame, names: EventNames = EventNames(), denominator: str = "any") -> DataFrame:
    """Per known top category: users with any event (or viewers), purchasers, ratio (%)."""
    return _part(clean, CATEGORY, names, denominator)


def funnel(clean: DataFrame, names: EventNames = EventNames(),
           parts: Sequence[str] = (OVERALL, MONTHLY, CATEGORY), category_denominator: str = "any") -> DataFrame:
    """The three parts stacked in one 19-column relation tagged by ``row_type``: one scan,
    one grouping-sets aggregate, one projection."""
    return _shape(_stage_totals(clean, parts, names), parts, category_denominator=category_denominator)
