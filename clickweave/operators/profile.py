"""Profiling queries on the raw table: shape, type mix, NULLs, categories, prices, repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from clickweave.config import delete_path, new_shared_path
from clickweave.functions.dims import category_depth
from clickweave.functions.joins import bounded
from clickweave.functions.numeric import money, pct, round_n
from clickweave.functions.select import percentiles_disc
from clickweave.schema import DEDUP_KEY, EventNames
from clickweave.sources.tables import with_month

NULL_AUDIT_COLUMNS = ("event_time", "event_type", "user_id", "product_id", "price", "brand", "category_code")


def monthly_shape(raw: DataFrame) -> DataFrame:
    """Per month: rows and distinct users, products, event types.

    One grouping-sets aggregate at (month, user), (month, product) and (month, type) grain,
    then a count of the non-NULL keys per month; the row total is the sum of the per-type
    counts. Each input row is expanded three times (Spark's own rewrite of three COUNT
    DISTINCTs plus COUNT(*) expands it four times)."""
    m = with_month(raw)
    level1 = (m.groupingSets([["event_month", "user_id"], ["event_month", "product_id"],
                              ["event_month", "event_type"]], "event_month", "user_id", "product_id", "event_type")
              .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")))
    # grouping_id bits over (event_month, user_id, product_id, event_type): 1 = grouped out
    by_type = F.col("gid") == 0b0110
    return level1.groupBy(F.col("event_month").alias("month")).agg(
        F.sum(F.when(by_type, F.col("n"))).alias("total_rows"),
        F.count("user_id").alias("unique_users"),
        F.count("product_id").alias("unique_products"),
        F.count(F.when(by_type, F.col("event_type"))).alias("unique_event_types"))


def event_type_mix(raw: DataFrame) -> DataFrame:
    """Rows per event type and share of all rows (%). The share is a window over the
    per-type aggregate, i.e. over a handful of rows."""
    counts = raw.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
    return counts.withColumn("pct", pct(F.col("total"), F.sum("total").over(Window.partitionBy())))


def null_audit(raw: DataFrame, cols: Sequence[str] = NULL_AUDIT_COLUMNS) -> DataFrame:
    return raw.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def top_categories(raw: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent non-NULL category codes (ties by code)."""
    return (raw.where(F.col("category_code").isNotNull())
            .groupBy("category_code").agg(F.count(F.lit(1)).alias("occurrences"))
            .orderBy(F.col("occurrences").desc(), F.col("category_code").asc())
            .limit(n))


def category_depth_histogram(raw: DataFrame) -> DataFrame:
    return (raw.where(F.col("category_code").isNotNull())
            .groupBy(category_depth(F.col("category_code")).alias("depth"))
            .agg(F.count(F.lit(1)).alias("occurrences")))


def purchase_price_profile(raw: DataFrame, names: EventNames = EventNames(), exact: bool = False,
                           accuracy: int = 10_000) -> DataFrame:
    """Purchase prices: min, max, mean (2dp), quartiles, zero and NULL counts.

    ``exact=False`` uses mergeable quantile sketches (one pass, bounded memory), like the
    approximate quantiles of the source model. ``exact=True`` returns PERCENTILE_DISC values: the
    purchases are counted by price (partial counts before the shuffle, so a common price is one row
    per task) into a table, and everything else is read off it, the percentiles by narrowing
    histograms (``functions.select``). The raw table is read once, and no task ranks all prices.
    """
    buys = raw.where(F.col("event_type") == names.purchase)
    probs, labels = [0.25, 0.5, 0.75], ("p25", "median", "p75")
    if not exact:
        q = F.percentile_approx("price", probs, accuracy)
        mean = F.sum(money(F.col("price"))) / F.nullif(F.count("price"), F.lit(0))
        return buys.agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), round_n(mean, 2).alias("avg_price"),
                        *[q[i].alias(n) for i, n in enumerate(labels)],
                        F.count_if(F.col("price") == 0).alias("zero_price_rows"),
                        F.count_if(F.col("price").isNull()).alias("null_price_rows"))
    spark, path = raw.sparkSession, new_shared_path(raw.sparkSession, "prices")
    buys.groupBy("price").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    by_price, known = spark.read.schema("price double, n long").parquet(path), F.col("price").isNotNull()
    quartiles = percentiles_disc(by_price, probs, "price")
    total = F.sum(money(F.col("price")) * F.col("n"))
    profile = by_price.agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        round_n(total / F.nullif(F.sum(F.when(known, F.col("n"))), F.lit(0)), 2).alias("avg_price"),
        *[F.lit(q).cast("double").alias(n) for q, n in zip(quartiles, labels)],
        F.coalesce(F.sum(F.when(F.col("price") == 0, F.col("n"))), F.lit(0)).alias("zero_price_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_price_rows"))
    row = spark.createDataFrame(profile.collect(), profile.schema)
    delete_path(spark, path)
    return row


def duplicate_keys(raw: DataFrame, n: int = 10, key: Sequence[str] = DEDUP_KEY) -> DataFrame:
    """Keys that occur more than once, the n most repeated (ties by key, NULLs first).

    Nearly all keys occur once, so the keys themselves are not shuffled: their 64-bit hashes are counted
    first (16 bytes a row). Only rows whose hash occurs as often as the n-th most frequent one are read
    again, and counted by the keys. Keys of one hash can make it look more frequent than they are; if
    the n-th key found has a lower count than was asked for, all hashes down to its count are looked at."""
    spark, path = raw.sparkSession, new_shared_path(raw.sparkSession, "repeated")
    hashed = raw.select(*key, F.xxhash64(*key).alias("_h"))
    hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").write.parquet(path)
    repeated = spark.read.schema("_h long, _c long").parquet(path)
    most = [r[0] for r in repeated.select("_c").orderBy(F.col("_c").desc()).limit(n).collect()]
    least = most[-1] if len(most) == n else 2
    order = [F.col("occurrences").desc(), *[F.col(c).asc_nulls_first() for c in key]]
    while True:
        wanted = repeated.where(F.col("_c") >= least).select("_h")
        found = (hashed.join(bounded(wanted), "_h", "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences"))
                 .where(F.col("occurrences") > 1).orderBy(*order).limit(n))
        rows = found.collect()
        seen = rows[-1].occurrences if len(rows) == n else 2
        if seen >= least or least == 2:
            break
        least = seen
    top = spark.createDataFrame(rows, found.schema)
    delete_path(spark, path)
    return top


def duplicate_drilldown(raw: DataFrame, user_id: str | None = None, product_id: str | None = None,
                        event_type: str | None = None) -> DataFrame:
    """For one user, product and type: copies and price range per timestamp.

    Without arguments the most repeated key of :func:`duplicate_keys` among keys with a
    known user and product is examined; the one-row key frame is broadcast."""
    if user_id is None or product_id is None or event_type is None:
        known = raw.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
        pick = duplicate_keys(known, 1).select("user_id", "product_id", "event_type")
        rows = raw.join(F.broadcast(pick), ["user_id", "product_id", "event_type"])
    else:
        rows = raw.where((F.col("user_id") == user_id) & (F.col("product_id") == product_id)
                         & (F.col("event_type") == event_type))
    return (rows.groupBy("event_time", "event_type", "user_id", "product_id")
            .agg(F.count(F.lit(1)).alias("occurrences"),
                 F.min("price").alias("price_min"), F.max("price").alias("price_max")))
