"""The month-partitioned, event-type-clustered event table.

Layout: ``event_month=YYYY-MM-01/`` directories, rows sorted inside each file by
(event_type, user_id) so parquet row-group statistics skip other event types. Month
predicates must be written on ``event_month`` to be pruned at planning time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickweave.config import delete_path
from clickweave.schema import EVENT_SCHEMA

MONTH = "event_month"


def with_month(df: DataFrame, ts: str = "event_time") -> DataFrame:
    if MONTH in df.columns:
        return df
    return df.withColumn(MONTH, F.trunc(F.to_date(F.col(ts)), "MM"))


def write_event_table(df: DataFrame, path: str, cluster_by: Sequence[str] = ("event_type", "user_id"), mode: str = "overwrite",
                      max_records_per_file: int = 20_000_000, within: Sequence[str] = (), rebalance: bool = True) -> None:
    """Write ``df`` partitioned by month (and by the columns ``within`` a month). With ``mode='overwrite'``
    only the partitions present in ``df`` are replaced (dynamic partition overwrite); ``mode='append'``
    adds to them.

    With ``rebalance``, rows are shuffled by partition first: adaptive execution splits a large month into
    tasks of the advisory size and packs small ones, so a month has about (its bytes / advisory size)
    sorted files however many tasks computed it. Without, every task writes its rows of each month
    as they come: one shuffle less, for rows that have just been shuffled in tasks of the advisory size."""
    out, parts = with_month(df), (MONTH, *within)
    if rebalance:
        out = out.hint("rebalance", *parts)
    (out.sortWithinPartitions(*parts, *cluster_by).write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*parts).parquet(path))


def write_clustered(df: DataFrame, path: str, cluster_by: Sequence[str] = ("event_type", "user_id"),
                    spread_by: Sequence[str] = ("event_time", "product_id"), bloom: Sequence[str] = ("user_id", "product_id"),
                    distinct: int = 1_000_000, max_records_per_file: int = 20_000_000) -> None:
    """Write ``df`` partitioned by month, its files being ranges of the columns ``cluster_by`` inside a month, with
    bloom filters on ``bloom`` (``distinct`` values a row group are expected). The rows of one user and type
    lie in one file, or a few neighbouring ones: ``spread_by`` continues the order, so that a user with
    a large share of the rows is cut into ranges like any others. Only the months in ``df`` are replaced."""
    order = (MONTH, *cluster_by, *spread_by)
    writer = (with_month(df).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_records_per_file))
    for column in bloom:
        writer = (writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct)))
    writer.partitionBy(MONTH).parquet(path)


def drop_months(spark: SparkSession, path: str, months: Sequence) -> None:
    """Remove the partitions of ``months`` (DATEs)."""
    for month in months:
        delete_path(spark, f"{path.rstrip('/')}/{MONTH}={month}")


def restrict_period(df: DataFrame, start, end) -> DataFrame:
    """Rows with start <= event month < end (DATEs, first of month). On a month-partitioned
    table the predicate is on the partition column and prunes directories."""
    if MONTH in df.columns:
        return df.where((F.col(MONTH) >= F.lit(start)) & (F.col(MONTH) < F.lit(end)))
    day = F.to_date(F.col("event_time"))
    return df.where((day >= F.lit(start)) & (day < F.lit(end)))


def raw_table_schema() -> T.StructType:
    return T.StructType([*EVENT_SCHEMA.fields, T.StructField(MONTH, T.DateType(), True)])


def read_event_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a table written by :func:`write_event_table`; partition values typed as DATE."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)
