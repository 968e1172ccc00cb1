"""Registry of named queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables of ``sf_dir`` through the fixture rule; the raw and
clean tables are persisted once per ``sf_dir`` (see :mod:`clickweave.plans.catalog`) and
shared by all queries of the process.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickweave.config import bound_tasks, delete_path, ensure_checkpoint_dir, path_bytes
from clickweave.operators import bitmaps as B
from clickweave.operators import checks as K
from clickweave.operators import clean as C
from clickweave.operators import cohort as H
from clickweave.operators import cohort_state as S
from clickweave.operators import funnel as Fn
from clickweave.operators import overview as O
from clickweave.operators import price_sketch as Q
from clickweave.operators import product as P
from clickweave.operators import profile as E
from clickweave.operators import rfm as R
from clickweave.operators import sketch as X
from clickweave.plans.catalog import EventCatalog
from clickweave.schema import CSV_TIME_FORMAT, DEDUP_KEY, DEFAULT_PARAMS, EVENT_COLUMNS, Params
from clickweave.sources.fixtures import TABLES, commerce_events
from clickweave.sources.ingest import REPLAY, export_csv, ingest_events, read_quarantine, replay_quarantine
from clickweave.sources.tables import MONTH, raw_table_schema, read_event_table, write_clustered

Query = Callable[[SparkSession, str], DataFrame]

_catalogs: dict[str, EventCatalog] = {}
_lock = threading.Lock()


def catalog_for(spark: SparkSession, sf_dir: str) -> EventCatalog:
    """The process-wide catalog of ``sf_dir`` (persisted tables are reused across sessions)."""
    key = sf_dir.rstrip("/")
    with _lock:
        cat = _catalogs.get(key)
        if cat is None or cat.spark is not spark:
            ensure_checkpoint_dir(spark)
            bound_tasks(spark, sum(path_bytes(spark, f"{key}/{t}.parquet") for t in TABLES))
            fresh = EventCatalog(spark, lambda: commerce_events(spark, key), DEFAULT_PARAMS,
                                 root=cat.root if cat else None, rebalance=False)
            if cat is not None:
                fresh._paths = dict(cat._paths)
            _catalogs[key] = cat = fresh
        return cat


def _raw(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(catalog_for(spark, d).raw().select(*EVENT_COLUMNS))


def _raw_with(f: Callable[[DataFrame, Params], DataFrame]) -> Query:
    return lambda spark, d: f(catalog_for(spark, d).raw().select(*EVENT_COLUMNS), catalog_for(spark, d).params)


def _raw_table(f: Callable[[DataFrame], DataFrame]) -> Query:
    """For queries that benefit from the month partition column (pruning)."""
    return lambda spark, d: f(catalog_for(spark, d).raw())


def _clean(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(catalog_for(spark, d).clean())


def _dedup(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_dedup(C.clean_filter(catalog_for(spark, d).raw().select(*EVENT_COLUMNS)))


def _key_and(*cols: str) -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return catalog_for(spark, d).clean().select(*DEDUP_KEY, *cols)
    return q


def _fields() -> dict[str, Column]:
    """The nine fields of an event as CSV text."""
    text = {c: F.col(c).cast("string") for c in EVENT_COLUMNS} | {"event_time": F.date_format("event_time", CSV_TIME_FORMAT)}
    return {c: F.coalesce(v, F.lit("")) for c, v in text.items()}


def _write_lines(rows: DataFrame, line: Column, path: str) -> None:
    """Each task writes its lines as they are, under the header as the name of their one column."""
    (rows.select(line.alias(",".join(EVENT_COLUMNS))).write
     .options(header=True, sep="\x01", quote="", escapeQuotes=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
     .csv(path))


def _planted_csv(cat: EventCatalog, path: str) -> None:
    """The raw rows as CSV, and every 37th product's rows once more, broken in one of five ways: a
    bad time, a bad price, too few fields, an empty time, an empty type."""
    raw = cat.raw().select(*EVENT_COLUMNS)
    export_csv(raw, f"{path}/good")
    way = F.floor(F.col("product_id").cast("long") / 37) % 5
    rows = raw.where(F.col("product_id").cast("long") % 37 == 0)
    f = _fields()
    f |= {"event_time": F.when(way == 0, "not a time").when(way == 3, "").otherwise(f["event_time"]),
          "event_type": F.when(way == 4, "").otherwise(f["event_type"]), "price": F.when(way == 1, "dear").otherwise(f["price"])}
    fields = list(f.values())
    _write_lines(rows, F.when(way == 2, F.concat_ws(",", *fields[:5])).otherwise(F.concat_ws(",", *fields)), f"{path}/bad")


def _repairable_csv(cat: EventCatalog, path: str) -> None:
    """Every 41st product's rows, broken in one of four ways: a time in ISO format, a decimal comma, the
    last field missing, and a time that nobody can read."""
    raw = cat.raw().select(*EVENT_COLUMNS)
    way = F.floor(F.col("product_id").cast("long") / 41) % 4
    f = _fields()
    comma = F.when(F.col("price").isNull(), "").otherwise(F.concat(F.lit('"'), F.regexp_replace(f["price"], "[.]", ","), F.lit('"')))
    f |= {"event_time": F.when(way == 0, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(way == 3, "not a time").otherwise(f["event_time"]),
          "price": F.when(way == 1, comma).otherwise(f["price"])}
    fields = list(f.values())
    _write_lines(raw.where(F.col("product_id").cast("long") % 41 == 0),
                 F.when(way == 2, F.concat_ws(",", *fields[:8])).otherwise(F.concat_ws(",", *fields)), path)


def _loaded(spark: SparkSession, d: str) -> str:
    """The table (and its rejected rows beside it) that ingest writes from the planted files, which it is
    given twice: the ledger knows them the second time."""
    cat = catalog_for(spark, d)

    def load(out: str) -> None:
        path = cat.scratch("csv")
        _planted_csv(cat, path)
        try:
            for _ in range(2):
                ingest_events(spark, [f"{path}/good", f"{path}/bad"], out=out)
        finally:
            delete_path(spark, path)

    return cat.persisted("ingested", load)


def _ingest(spark: SparkSession, d: str) -> DataFrame:
    return read_event_table(spark, _loaded(spark, d), raw_table_schema()).select(*EVENT_COLUMNS)


def _quarantine(spark: SparkSession, d: str) -> DataFrame:
    return read_quarantine(spark, _loaded(spark, d)).select("event_time", "event_type", "product_id", "reason")


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """What two replays of a quarantine have put into the table."""
    cat = catalog_for(spark, d)

    def load(out: str) -> None:
        path = cat.scratch("csv")
        _repairable_csv(cat, path)
        try:
            ingest_events(spark, path, out=out)
        finally:
            delete_path(spark, path)
        for _ in range(2):
            replay_quarantine(spark, out)

    return spark.read.parquet(cat.persisted("replayed", load)).where(F.col("load") == REPLAY).select(*EVENT_COLUMNS)


def _incremental(spark: SparkSession, d: str) -> DataFrame:
    """All months but the last are loaded and cleaned, then all: only the last one is found changed."""
    cat = catalog_for(spark, d)

    def build(path: str) -> None:
        raw = cat.raw()
        last = raw.agg(F.max("event_month")).first()[0]
        C.refresh_clean(raw.where(F.col("event_month") < last), path)
        if C.refresh_clean(raw, path) != [last]:
            raise AssertionError("a month that has not changed was cleaned again")

    return spark.read.parquet(cat.persisted("clean-incremental", build)).select(*C.CLEAN_COLUMNS)


def _by_month(cat: EventCatalog, table: DataFrame, store: Callable[[DataFrame, str, list], None], path: str) -> None:
    """Load a store month by month."""
    for month in [r[0] for r in table.select(MONTH).distinct().orderBy(MONTH).collect()]:
        store(table, path, [month])


def _sketch_store(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog_for(spark, d)
    return X.read_sketches(spark, cat.persisted("sketches", lambda p: _by_month(cat, cat.clean(), X.store_sketches, p)))


def _price_store(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog_for(spark, d)
    return spark.read.parquet(cat.persisted("price-sketches", lambda p: _by_month(cat, cat.raw(), Q.store_prices, p)))


def _mask_store(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog_for(spark, d)
    return S.read_masks(spark, cat.persisted("cohort-masks", lambda p: _by_month(cat, cat.clean(), S.store_masks, p)))


def _bitmap_store(spark: SparkSession, d: str) -> DataFrame:
    cat = catalog_for(spark, d)

    def build(path: str) -> None:
        _by_month(cat, cat.clean(), lambda clean, p, months: B.store_bitmaps(clean, p, path + "_users", months), path)

    return spark.read.parquet(cat.persisted("bitmaps", build))


def _user_drilldown(spark: SparkSession, d: str) -> DataFrame:
    """The drill-down into one named user, product and type (those of the most repeated key) on the
    clustered layout, where the names reach the scan."""
    cat = catalog_for(spark, d)
    path = cat.persisted("raw-clustered", lambda p: write_clustered(cat.raw(), p))
    raw = read_event_table(spark, path, raw_table_schema())
    known = raw.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    names = E.duplicate_keys(known.select(*EVENT_COLUMNS), 1).select("user_id", "product_id", "event_type").first() or ("", "", "")
    return E.duplicate_drilldown(raw.select(*EVENT_COLUMNS), *names)


def _streamed(spark: SparkSession, d: str) -> str:
    """The tables kept by a stream over the raw table's files, in several micro-batches."""
    from clickweave.streaming.complete import stream_table

    cat = catalog_for(spark, d)

    def run(root: str) -> None:
        files = len(cat.raw().inputFiles())
        events = (spark.readStream.schema(raw_table_schema()).option("maxFilesPerTrigger", max(1, -(-files // 3)))
                  .parquet(cat.raw_path()).select(*EVENT_COLUMNS))
        stream_table(events, root, buckets=2).trigger(availableNow=True).start().awaitTermination()

    return cat.persisted("streamed", run)


def _stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    from clickweave.streaming.complete import read_stream_clean

    return read_stream_clean(spark, _streamed(spark, d))


def _stream_kpis(spark: SparkSession, d: str) -> DataFrame:
    from clickweave.streaming.complete import read_stream_kpis

    return read_stream_kpis(spark, _streamed(spark, d))


def _sketches(spark: SparkSession, d: str) -> DataFrame:
    return X.sketch_accuracy(catalog_for(spark, d).clean(), _sketch_store(spark, d), ["event_month", "category_top"])


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return X.overlap_accuracy(catalog_for(spark, d).clean(), _sketch_store(spark, d), ["event_month", "category_top"])


def _percentiles(spark: SparkSession, d: str) -> DataFrame:
    return E.purchase_price_profile(catalog_for(spark, d).raw().select(*EVENT_COLUMNS), exact=True)


#: A category of the fixture, for the checks of one that is named.
NAMED_CATEGORY = "promo"


QUERIES: dict[str, Query] = {
    # load and profile
    "ingest_events": _ingest,
    "quarantine_events": _quarantine,
    "quarantine_replay": _replayed,
    "eda_monthly_shape": _raw_table(E.monthly_shape),
    "eda_event_type_mix": _raw(E.event_type_mix),
    "eda_null_audit": _raw(E.null_audit),
    "eda_top_categories": _raw_with(lambda r, p: E.top_categories(r, p.top_categories)),
    "eda_category_depth": _raw(E.category_depth_histogram),
    "eda_purchase_price_profile": _percentiles,
    "eda_price_quantiles": lambda s, d: Q.quantile_accuracy(catalog_for(s, d).raw(), _price_store(s, d)),
    "eda_duplicate_keys": _raw_with(lambda r, p: E.duplicate_keys(r, p.top_duplicates)),
    "eda_duplicate_drilldown": _raw(E.duplicate_drilldown),
    "eda_user_drilldown": _user_drilldown,
    # clean
    "clean_filter": lambda s, d: C.clean_filter(catalog_for(s, d).raw().select(*EVENT_COLUMNS)),
    "clean_dedup": _dedup,
    "clean_time_dims": _key_and("event_date", "event_month", "event_hour", "event_day_of_week"),
    "clean_category": _key_and("category_code", "category_top"),
    "clean_brand": _key_and("brand"),
    "clean_price_bucket": _key_and("price", "price_bucket"),
    "clean_events": lambda s, d: C.clean_events(catalog_for(s, d).raw()),
    "incremental_clean": _incremental,
    # funnel
    "funnel_user_flags": _clean(Fn.user_flags),
    "funnel_overall": _clean(Fn.funnel_overall),
    "funnel_monthly_trend": _clean(Fn.funnel_monthly_trend),
    "funnel_category_cvr": _clean(Fn.funnel_category_cvr),
    "funnel": _clean(Fn.funnel),
    "check_funnel_overall": _clean(K.check_funnel_overall),
    "check_funnel_monthly": _clean(K.check_funnel_monthly),
    "check_funnel_category": _clean(K.check_funnel_category),
    "check_funnel_rates": _clean(lambda c: K.check_funnel_rates(Fn.funnel(c))),
    # cohort
    "cohort_first_purchase": _clean(H.first_purchase),
    "cohort_user_weeks": _clean(H.user_weeks),
    "cohort_activity": _clean(H.cohort_activity),
    "cohort_size": _clean(H.cohort_size),
    "cohort_retention": _clean(H.cohort_retention),
    "check_cohort": _clean(lambda c: K.check_cohort(H.cohort_retention(c))),
    "check_cohort_sizes": _clean(lambda c: K.check_cohort_sizes(H.cohort_retention(c), c)),
    "cohort_state_retention": lambda s, d: S.retention(_mask_store(s, d)),
    # rfm
    "rfm_raw": _clean(R.rfm_raw),
    "rfm_scores": lambda s, d: catalog_for(s, d).rfm().select(
        "user_id", "recency_days", "frequency", "monetary", "r_score", "m_score", "f_score"),
    "rfm_segments": lambda s, d: catalog_for(s, d).rfm(),
    "rfm": lambda s, d: catalog_for(s, d).rfm(),
    "check_rfm_recency": lambda s, d: K.check_rfm_recency(catalog_for(s, d).rfm()),
    "check_rfm_segments": lambda s, d: K.check_rfm_segments(catalog_for(s, d).rfm()),
    # product
    "product_metrics": _clean(P.product_metrics),
    "check_product_category": lambda s, d: K.check_product_category(catalog_for(s, d).product(), catalog_for(s, d).params.top_check),
    "check_product_monthly": lambda s, d: K.check_product_monthly(catalog_for(s, d).product()),
    # the category under check is a parameter; by default the top-revenue category
    # (electronics in the source data set)
    "check_electronics_product": lambda s, d: K.check_category_product(
        catalog_for(s, d).product(), catalog_for(s, d).params.check_category),
    "check_electronics_clean": lambda s, d: K.check_category_clean(
        catalog_for(s, d).clean(), catalog_for(s, d).product(), catalog_for(s, d).params.check_category),
    "check_named_category_product": lambda s, d: K.check_category_product(catalog_for(s, d).product(), NAMED_CATEGORY),
    "check_named_category_clean": lambda s, d: K.check_category_clean(catalog_for(s, d).clean(), category=NAMED_CATEGORY),
    "check_month_completeness": lambda s, d: K.check_month_completeness(
        catalog_for(s, d).raw(), catalog_for(s, d).params.check_month),
    # overview
    "overview_monthly": _clean(O.overview_monthly),
    "overview_event_mix": _clean(O.overview_event_mix),
    "overview": _clean(O.overview),
    # streaming and sketches
    "stream_dedup": _stream_dedup,
    "stream_kpis": _stream_kpis,
    "product_sketches": _sketches,
    "sketch_overlaps": _overlaps,
    "product_distinct_rollup": lambda s, d: B.distinct_rollup(
        _bitmap_store(s, d), [["event_month", "category_top"], ["event_month"], ["category_top"], []]),
}
