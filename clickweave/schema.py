"""The canonical event schema, event names and analysis parameters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Canonical raw event columns, in file order.
EVENT_SCHEMA = T.StructType([
    T.StructField("event_time", T.TimestampNTZType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("product_id", T.StringType(), True),
    T.StructField("category_id", T.StringType(), True),
    T.StructField("category_code", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("user_session", T.StringType(), True),
])
EVENT_COLUMNS = tuple(f.name for f in EVENT_SCHEMA.fields)
REQUIRED_COLUMNS = ("event_time", "event_type")

# One logical event: repeated tracking rows share all five.
DEDUP_KEY = ("event_time", "event_type", "user_id", "user_session", "product_id")
# Columns ordering the copies of one key, so the survivor is the same on every run.
DEDUP_ORDER = ("price", "category_code", "brand", "category_id")

# Time format of the CSV event files, e.g. 2019-11-17 16:58:15 UTC.
CSV_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"

UNKNOWN = "unknown"

# Price bucket upper bounds (half-open) of the source model.
PRICE_BOUNDS = (50, 200, 500, 1000)

CLEAN_COLUMNS = (
    "event_time", "event_date", "event_month", "event_hour", "event_day_of_week",
    "event_type", "user_id", "user_session", "product_id", "category_id",
    "category_code", "category_top", "brand", "price", "price_bucket",
)


@dataclass(frozen=True)
class EventNames:
    """Event-type labels; the funnel stages in order."""
    view: str = "view"
    cart: str = "cart"
    purchase: str = "purchase"

    @property
    def all(self) -> tuple[str, str, str]:
        return (self.view, self.cart, self.purchase)


@dataclass(frozen=True)
class Params:
    """Knobs of the analyses. Defaults are the source model's values."""
    events: EventNames = field(default_factory=EventNames)
    # analysed months [start, end), first days; None = all data
    period: tuple[dt.date, dt.date] | None = None
    price_bounds: tuple = PRICE_BOUNDS
    # RFM
    reference_date: dt.date = dt.date(2020, 1, 1)
    tiles: int = 5
    repeat_threshold: int = 2
    # cohort: offsets w1..w{weeks} after w0
    weeks: int = 13
    # checks
    check_category: str | None = None     # None: the top-revenue category of the data
    check_month: dt.date = dt.date(2019, 12, 1)
    top_categories: int = 20
    top_duplicates: int = 10
    top_check: int = 10


DEFAULT_PARAMS = Params()
