"""Named relations over one event source, each persisted at most once.

The source model defines its analyses as unmaterialised views, so every read of the clean
view repeats the scan, the de-duplication shuffle and the enrichment. Here the raw table
and the clean table are written once, month-partitioned and clustered by event type, into
the session's shared checkpoint folder; all views read the clean table. Relations that
need several Spark jobs to build (the RFM table with its exact n-tiles, the product table
read by four checks) are persisted too, so their consumers never rebuild them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickweave.config import new_shared_path
from clickweave.operators import clean as C
from clickweave.operators import product as P
from clickweave.operators import rfm as R
from clickweave.schema import CLEAN_COLUMNS, DEFAULT_PARAMS, Params
from clickweave.sources.tables import raw_table_schema, read_event_table, write_event_table


class EventCatalog:
    def __init__(self, spark: SparkSession, source: Callable[[], DataFrame],
                 params: Params = DEFAULT_PARAMS, root: str | None = None, rebalance: bool = True):
        self.spark = spark
        self.source = source
        self.params = params
        self.rebalance = rebalance  # not needed for a source that has just been shuffled in tasks of the advisory size
        self.root = root or new_shared_path(spark, "catalog")
        self._paths: dict[str, str] = {}
        self._lock = threading.RLock()

    @classmethod
    def over_table(cls, spark: SparkSession, raw_path: str, params: Params = DEFAULT_PARAMS,
                   root: str | None = None, clean_path: str | None = None) -> "EventCatalog":
        """Catalog over an existing month-partitioned raw table (e.g. written by ingest) and,
        optionally, an existing clean table."""
        cat = cls(spark, lambda: read_event_table(spark, raw_path, raw_table_schema()), params, root)
        cat._paths["raw"] = raw_path
        if clean_path is not None:
            cat._paths["clean"] = clean_path
        return cat

    # -- persisted relations ------------------------------------------------------------------
    def persisted(self, name: str, build: Callable[[str], None]) -> str:
        """The path of a table that ``build`` writes once; later calls reuse it."""
        with self._lock:
            if name not in self._paths:
                path = f"{self.root}/{name}"
                build(path)
                self._paths[name] = path
            return self._paths[name]

    def raw(self) -> DataFrame:
        """The raw event table (nine columns + ``event_month`` partition column)."""
        path = self.persisted("raw", lambda p: write_event_table(self.source(), p, rebalance=self.rebalance))
        return read_event_table(self.spark, path, raw_table_schema())

    def raw_path(self) -> str:
        self.raw()
        return self._paths["raw"]

    def clean(self) -> DataFrame:
        path = self.persisted("clean", lambda p: C.write_clean(self.raw(), p, params=self.params))
        return read_event_table(self.spark, path).select(*CLEAN_COLUMNS)

    def rfm(self) -> DataFrame:
        path = self.persisted(
            "rfm", lambda p: R.rfm(self.clean(), self.params).write.mode("overwrite").parquet(p))
        return self.spark.read.parquet(path)

    def product(self) -> DataFrame:
        path = self.persisted(
            "product", lambda p: P.product_metrics(self.clean(), self.params.events)
            .write.mode("overwrite").partitionBy("event_month").parquet(p))
        return self.spark.read.parquet(path).select(*P.PRODUCT_KEYS, *[
            c for c in ("total_events", "unique_users", "unique_products", "viewers", "carters",
                        "purchasers", "revenue", "avg_order_value", "cvr")])

    def scratch(self, name: str) -> str:
        """A fresh location under this catalog's root."""
        return new_shared_path(self.spark, f"{self.root.rsplit('/', 1)[-1]}-{name}")
