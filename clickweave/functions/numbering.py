"""Consecutive numbers for the rows of a table, in two levels and without a global window.

A table is written with ``monotonically_increasing_id``: a row's part in the upper and its place in the
part in the lower 33 bits. Rows are counted by part, and a running sum over the parts (one row each, at
most as many as the tasks that wrote the table) is joined back: offset plus place is the row's number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clickweave.config import delete_path, list_path, new_shared_path

_PLACE_BITS = 33  # of monotonically_increasing_id


def write_numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as its tasks hold it, with the part and place of every row in ``name``; and where."""
    path = new_shared_path(df.sparkSession, "numbered")
    rows = df.withColumn(name, F.monotonically_increasing_id())
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path), path


def part_offsets(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per column of :func:`write_numbered` (``_of``) and part: rows before it, and rows of the table."""
    parts = F.array(*[F.struct(F.lit(n).alias("_of"), F.shiftright(n, _PLACE_BITS).alias("_part")) for n in names])
    counts = df.select(F.explode(parts).alias("x")).groupBy("x._of", "x._part").agg(F.count(F.lit(1)).alias("_c"))
    every = Window.partitionBy("_of")
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_of", "_part", F.sum("_c").over(every).alias("_total"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))


def with_number(df: DataFrame, offsets: DataFrame, name: str, out: str, total: str | None = None) -> DataFrame:
    """``df`` with its rows' numbers from 0 (and how many rows there are); ``name`` is left out."""
    mine = F.broadcast(offsets.where(F.col("_of") == name).drop("_of"))  # a row per task that wrote the table
    numbered = df.withColumn("_part", F.shiftright(name, _PLACE_BITS)).join(mine, "_part")
    numbered = numbered.withColumn(out, F.col("_before") + F.col(name).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    if total is not None:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_part", "_total", "_before", name)


def extend_ids(spark: SparkSession, path: str, keys: DataFrame, number: str = "uid") -> DataFrame:
    """The dictionary at ``path``, from the one column of ``keys`` to numbers from 0 without a gap, after
    the keys that it lacks have been added behind the others. Known keys keep their numbers, so adding
    the same keys again changes nothing. NULL keys get no number."""
    column = keys.columns[0]
    fresh = keys.where(F.col(column).isNotNull()).distinct()
    parts = [n for n in list_path(spark, path) if n.startswith("part=")]
    start = 0
    if parts:
        known = spark.read.parquet(path)
        start = known.agg(F.max(number)).first()[0]
        start = 0 if start is None else start + 1
        fresh = fresh.join(known.select(column), column, "left_anti")
    table, scratch = write_numbered(fresh, "_id")
    # one commit per addition: a folder that appears as a whole
    with_number(table, part_offsets(table, ["_id"]), "_id", number).withColumn(number, F.col(number) + start).write.mode("overwrite").parquet(
        f"{path}/part={len(parts)}")
    delete_path(spark, scratch)
    return spark.read.parquet(path).select(column, number)
