"""``clean_events``: filter, de-duplicate and enrich raw events.

One full shuffle on the five-column key is unavoidable (repeated rows must meet). The
``row_number() == 1`` filter is planned with a partial WindowGroupLimit before the
exchange, so a key repeated many times sends one row per map task, not all copies.
Because the key contains event_time, copies never cross months: a month can be cleaned
on its own (see :func:`rebuild_months`).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from clickweave.config import delete_path, list_path
from clickweave.functions.dims import brand_norm, category_top, price_bucket, time_dims
from clickweave.schema import (
    CLEAN_COLUMNS, DEDUP_KEY, DEDUP_ORDER, DEFAULT_PARAMS, EVENT_COLUMNS, EventNames, Params, UNKNOWN,
)
from clickweave.sources.tables import MONTH, drop_months, restrict_period, with_month, write_event_table


def clean_filter(raw: DataFrame, names: EventNames = EventNames()) -> DataFrame:
    """Keep rows with time, type, user and product, and a type of the funnel domain."""
    return raw.where(
        F.col("event_time").isNotNull() & F.col("event_type").isNotNull()
        & F.col("user_id").isNotNull() & F.col("product_id").isNotNull()
        & F.col("event_type").isin(*names.all))


def clean_dedup(df: DataFrame, key: Sequence[str] = DEDUP_KEY,
                order: Sequence[str] = DEDUP_ORDER) -> DataFrame:
    """One row per key. The copy kept is the first by ``order`` (ascending, NULLs first),
    so the result does not depend on input order or partitioning. NULLs in the key
    (e.g. a missing session) form one group."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def add_time_dims(df: DataFrame) -> DataFrame:
    return df.withColumns(time_dims(F.col("event_time")))


def add_category(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "category_top": category_top(F.col("category_code")),
        "category_code": F.coalesce(F.col("category_code"), F.lit(UNKNOWN)),
    })


def add_brand(df: DataFrame) -> DataFrame:
    return df.withColumn("brand", brand_norm(F.col("brand")))


def add_price_bucket(df: DataFrame, bounds: Sequence[float] = DEFAULT_PARAMS.price_bounds) -> DataFrame:
    return df.withColumn("price_bucket", price_bucket(F.col("price"), bounds))


def enrich(df: DataFrame, params: Params = DEFAULT_PARAMS, keep: Sequence[str] = ()) -> DataFrame:
    """Derived columns of the clean table, in the published column order (plus ``keep``)."""
    out = add_price_bucket(add_brand(add_category(add_time_dims(df))), params.price_bounds)
    return out.select(*CLEAN_COLUMNS, *keep)


def clean_events(raw: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Filter (to ``params.period`` when set), de-duplicate, enrich. Partition columns of
    ``raw`` other than the nine canonical ones are ignored."""
    if params.period is not None:
        raw = restrict_period(raw, *params.period)
    return enrich(clean_dedup(clean_filter(raw, params.events)), params)


def rebuild_months(raw: DataFrame, clean_path: str, months: Iterable, params: Params = DEFAULT_PARAMS) -> None:
    """Re-clean only ``months`` (DATEs, first of month) and replace those partitions of the
    clean table in place; other months are untouched (dynamic partition overwrite). A month that
    has no valid rows any more loses its partition."""
    months = list(months)
    month = F.col(MONTH) if MONTH in raw.columns else F.trunc(F.to_date("event_time"), "MM")
    src = raw.where(month.isin(months))
    # the filter alone decides whether a month is empty: de-duplication keeps a row of every key
    valid = clean_filter(src if params.period is None else restrict_period(src, *params.period), params.events)
    left = {r[0] for r in valid.select(F.trunc(F.to_date("event_time"), "MM").alias("m")).distinct().collect()}
    write_clean(src, clean_path, sorted(left), params)
    drop_months(raw.sparkSession, clean_path, [m for m in months if m not in left])


def write_clean(raw: DataFrame, clean_path: str, months: Iterable | None = None, params: Params = DEFAULT_PARAMS, at_once: int = 4) -> None:
    """Clean ``raw`` (its ``months``, all that it has: None) into the table at ``clean_path``, with one shuffle.

    The shuffle of the de-duplication is the only one: its tasks, which adaptive execution makes as large as
    advised, write what they hold of each month. So that files don't become small where there are many
    months, ``at_once`` of them are cleaned at a time; each reads its own partitions of the raw table."""
    raw = with_month(raw)
    if months is None:  # of a table partitioned by month no column is read for this
        seen = raw if params.period is None else restrict_period(raw, *params.period)
        months = sorted(r[0] for r in seen.select(MONTH).distinct().collect() if r[0] is not None)
    months = list(months)
    for i in range(0, len(months), at_once):
        part = raw.where(F.col(MONTH).isin(months[i:i + at_once]))
        write_event_table(clean_events(part, params), clean_path, rebalance=False)


# -- changed months -------------------------------------------------------------------------

def month_fingerprints(raw: DataFrame) -> DataFrame:
    """Per month: rows, and the sum and the exclusive or of the rows' 64-bit hashes, whatever their order. A
    row that comes twice, goes or changes changes the sum."""
    # a NULL changes a hash by its place alone, so each column says whether it is one
    row = F.xxhash64(*[x for c in EVENT_COLUMNS for x in (F.col(c), F.col(c).isNull())])
    return with_month(raw).select(MONTH, row.alias("h")).groupBy(MONTH).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("mixed"))


def refresh_clean(raw: DataFrame, clean_path: str, params: Params = DEFAULT_PARAMS) -> list:
    """Clean the months of ``raw`` that differ from those that the clean table was last built of, and drop
    those that are gone. Returns the months (DATEs) that changed. The fingerprints of the months, a few rows,
    are kept beside the table and written last: a refresh that failed is done again."""
    spark, kept = raw.sparkSession, clean_path.rstrip("/") + "_fingerprints"
    found = month_fingerprints(raw)
    now = {r[MONTH]: tuple(r) for r in found.collect() if r[MONTH] is not None}
    versions = sorted(int(v) for v in list_path(spark, kept) if v.isdigit())
    before = {r[MONTH]: tuple(r) for r in spark.read.parquet(f"{kept}/{versions[-1]}").collect()} if versions else {}
    changed = sorted(m for m in now.keys() | before.keys() if now.get(m) != before.get(m))
    if changed:
        rebuild_months(raw, clean_path, changed, params)
        spark.createDataFrame(list(now.values()), found.schema).coalesce(1).write.parquet(f"{kept}/{versions[-1] + 1 if versions else 0}")
        for v in versions[:-1]:
            delete_path(spark, f"{kept}/{v}")
    return changed
