"""Daily KPIs over an event stream, exact.

Exact distinct counts are not supported by a single streaming aggregation, so the
distinct-user measures use two chained windowed aggregations in append mode: first per
(window, user), then per window over those rows. State is bounded by the users active in
the open windows and is dropped when the watermark passes a window's end; a window is
emitted once closed, so the newest window of a finished stream stays open, and rows behind the
watermark are dropped. ``complete`` has every day and every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickweave.functions.numeric import money, round_n
from clickweave.schema import DEFAULT_PARAMS, Params
from clickweave.streaming.dedup import WATERMARK_COL, stream_clean

KPI_COLUMNS = ("day", "total_events", "view_events", "cart_events", "purchase_events", "revenue",
               "unique_users", "purchasers")


def stream_daily_kpis(events: DataFrame, delay: str = "1 hour", window: str = "1 day",
                      params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Per event-time window: events by type, purchase revenue, distinct users and buyers."""
    names = params.events
    t = F.col("event_type")
    clean = stream_clean(events, delay, params, keep_event_ts=True)
    per_user = clean.groupBy(F.window(WATERMARK_COL, window).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t == names.view).alias("nv"),
        F.count_if(t == names.cart).alias("nc"), F.count_if(t == names.purchase).alias("np"),
        F.sum(money(F.when(t == names.purchase, F.col("price")).otherwise(F.lit(0.0)))).alias("rev"))
    per_window = per_user.groupBy(F.window(F.window_time("w"), window).alias("d")).agg(
        F.sum("n").alias("total_events"), F.sum("nv").alias("view_events"),
        F.sum("nc").alias("cart_events"), F.sum("np").alias("purchase_events"),
        round_n(F.sum("rev"), 2).alias("revenue"),
        F.count(F.lit(1)).alias("unique_users"), F.count_if(F.col("np") > 0).alias("purchasers"))
    # windows are aligned on UTC epoch days; name each by its UTC date
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("d.start")) / 86400).cast("int"))
    return per_window.select(day.alias("day"), *KPI_COLUMNS[1:])
