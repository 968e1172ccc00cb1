"""RFM scoring and segments of buyers.

Recency and monetary scores are global quintiles. They are computed with the exact distributed
n-tile (``functions.ntile``), never with a window over all buyers in one task.
Ties, left open by the source model, are broken by (md5(user_id), user_id).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from clickweave.functions.ntile import exact_ntiles, tile_order
from clickweave.functions.numeric import money, round_n
from clickweave.schema import DEFAULT_PARAMS, Params

RFM_COLUMNS = ("user_id", "recency_days", "frequency", "monetary", "r_score", "f_score", "m_score",
               "rfm_score", "avg_rfm_score", "segment")

# Segment rules, first match wins, as (name, condition).
SEGMENT_RULES = (
    ("Champions", "r_score >= 4 AND f_score = 5 AND m_score >= 4"),
    ("Loyal", "r_score >= 3 AND f_score = 5"),
    ("High Value New", "r_score >= 4 AND f_score = 1 AND m_score >= 4"),
    ("Promising", "r_score >= 4 AND f_score = 1"),
    ("At Risk", "r_score <= 2 AND f_score = 5"),
    ("Hibernating", "r_score <= 2 AND m_score >= 4"),
)
FALLBACK_SEGMENT = "Lost"


def rfm_raw(clean: DataFrame, reference_date: dt.date = DEFAULT_PARAMS.reference_date,
            purchase: str = "purchase") -> DataFrame:
    """Per buyer: days from the last purchase date to ``reference_date``, distinct purchase
    days, total spend (2dp). Two aggregation levels: (user, day) then user."""
    days = (clean.where(F.col("event_type") == purchase)
            .groupBy("user_id", "event_date")
            .agg(F.sum(money(F.col("price"))).alias("spend")))
    per_user = days.groupBy("user_id").agg(
        F.max("event_date").alias("last_day"), F.count(F.lit(1)).alias("frequency"),
        F.sum("spend").alias("spend"))
    return per_user.select(
        "user_id",
        F.datediff(F.lit(reference_date), F.col("last_day")).cast("int").alias("recency_days"),
        "frequency", round_n(F.col("spend"), 2).alias("monetary"))


def rfm_scores(raw_scores: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Add r_score (recent = high), f_score (5 if repeat buyer else 1), m_score (high spend = high)."""
    base, ties = raw_scores.withColumn("_h", F.md5(F.col("user_id"))), ["_h", "user_id"]
    scored = exact_ntiles(base, params.tiles, {"r_score": tile_order("recency_days", ties, ascending=False),
                                               "m_score": tile_order("monetary", ties)})
    return scored.drop("_h").withColumn(
        "f_score", F.when(F.col("frequency") >= params.repeat_threshold, 5).otherwise(1))


def segment_expr() -> F.Column:
    expr = None
    for name, cond in SEGMENT_RULES:
        expr = (F.when if expr is None else expr.when)(F.expr(cond), F.lit(name))
    return expr.otherwise(F.lit(FALLBACK_SEGMENT))


def rfm_segments(scored: DataFrame) -> DataFrame:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.withColumns({
        "rfm_score": F.concat(r.cast("string"), f.cast("string"), m.cast("string")),
        "avg_rfm_score": round_n((r + f + m) / F.lit(3.0), 2),
        "segment": segment_expr(),
    })


def rfm(clean: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """The scored, segmented buyer table (10 columns)."""
    raw = rfm_raw(clean, params.reference_date, params.events.purchase)
    return rfm_segments(rfm_scores(raw, params)).select(*RFM_COLUMNS)
