"""Remove repeated tracking rows as they arrive.

Copies of one event share all five key columns, event_time included, so a watermark only
needs to cover how late a copy can arrive after the first one. State per key is dropped
once the watermark passes, which bounds the state store, and rows behind the watermark are
dropped, first copies too. The survivor is the first copy seen, so in a stream without late rows
the output equals the batch clean table on the key columns. ``complete`` loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from clickweave.operators.clean import clean_filter, enrich
from clickweave.schema import DEDUP_KEY, DEFAULT_PARAMS, Params

WATERMARK_COL = "event_ts"


def with_event_ts(df: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ). A TIMESTAMP_NTZ event time holds UTC
    wall-clock values; it becomes the UTC instant whatever the session time zone."""
    ts = F.col("event_time")
    if isinstance(df.schema["event_time"].dataType, T.TimestampNTZType):
        ts = F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())
    return df.withColumn(WATERMARK_COL, ts)


def stream_clean(events: DataFrame, delay: str = "1 hour", params: Params = DEFAULT_PARAMS,
                 keep_event_ts: bool = False) -> DataFrame:
    """Streaming (or batch) events -> de-duplicated, enriched clean rows. With
    ``keep_event_ts`` the watermarked column is kept for a downstream stateful step."""
    kept = (with_event_ts(clean_filter(events, params.events))
            .withWatermark(WATERMARK_COL, delay)
            .dropDuplicatesWithinWatermark(list(DEDUP_KEY)))
    return enrich(kept, params, keep=[WATERMARK_COL] if keep_event_ts else [])
