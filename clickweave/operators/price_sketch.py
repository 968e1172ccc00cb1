"""Purchase-price quantiles kept per month and merged.

Per month the store has a KLL sketch of the prices of all purchases. Quantiles of a month, or of any
set of months, come from the stored sketches alone; the rank of an estimate is within ``WITHIN`` of
the rank asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from clickweave.schema import EventNames
from clickweave.sources.tables import MONTH, drop_months, with_month

#: The sketches' size, and the share of all rows that an estimate's rank may be off.
K, WITHIN = 400, 0.02
QUARTILES = (("p25", 0.25), ("median", 0.5), ("p75", 0.75))


def price_sketches(raw: DataFrame, names: EventNames = EventNames(), k: int = K) -> DataFrame:
    buys = with_month(raw).where((F.col("event_type") == names.purchase) & F.col("price").isNotNull())
    return buys.groupBy(MONTH).agg(F.kll_sketch_agg_double("price", F.lit(k)).alias("prices"), F.count(F.lit(1)).alias("n"))


def store_prices(raw: DataFrame, path: str, months: Iterable | None = None, names: EventNames = EventNames(), k: int = K) -> None:
    """Write the sketches of ``months`` (all: None) of the raw table; other months of the store stay."""
    if months is not None:
        months = list(months)
        raw = with_month(raw).where(F.col(MONTH).isin(months))
        drop_months(raw.sparkSession, path, months)
    price_sketches(raw, names, k).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def price_quantiles(store: DataFrame, keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """Estimated quartiles by ``keys`` (none: over all months), from the store alone."""
    merged = store.groupBy(*keys).agg(F.kll_merge_agg_double("prices", F.lit(k)).alias("prices"), F.sum("n").alias("n"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("prices", F.lit(p)).alias(f"est_{c}") for c, p in QUARTILES])


def quantile_accuracy(raw: DataFrame, store: DataFrame, names: EventNames = EventNames(), within: float = WITHIN) -> DataFrame:
    """Per month and over all (month NULL): purchases with a price, and whether each estimate's rank among
    the events is within that share of the rank asked for."""
    buys = with_month(raw).where((F.col("event_type") == names.purchase) & F.col("price").isNotNull())
    counts = buys.groupBy(MONTH, "price").agg(F.count(F.lit(1)).alias("c"))
    every = F.lit(None).cast("date").alias(MONTH)
    guesses = price_quantiles(store, [MONTH]).unionByName(price_quantiles(store).select(every, "n", *[f"est_{c}" for c, _ in QUARTILES]))
    # a row per month and one for all
    both = counts.unionByName(counts.withColumn(MONTH, F.lit(None).cast("date"))).withColumnRenamed(MONTH, "m").join(
        F.broadcast(guesses), F.col("m").eqNullSafe(F.col(MONTH)))
    upto = {c: (F.sum(F.when(F.col("price") < F.col(f"est_{c}"), F.col("c")).otherwise(0)),
                F.sum(F.when(F.col("price") <= F.col(f"est_{c}"), F.col("c")).otherwise(0))) for c, _ in QUARTILES}
    total = F.sum("c")
    return both.groupBy(MONTH).agg(total.alias("purchases"), *[
        ((upto[c][0] <= (p + within) * total) & (upto[c][1] >= (p - within) * total)).alias(f"{c}_near") for c, p in QUARTILES])
