"""Helpers shared by the operators of this package."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickweave.config import new_shared_path

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a table may have to be broadcast; beyond it, joins shuffle and AQE splits skew.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared checkpoint folder and read back: lineage ends here, and
    a lost executor loses nothing."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(small: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it is counted to have at most ``limit`` rows; otherwise as
    it is, and Spark shuffles the join."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= limit else small


def fold(text_id: Column, folds: int) -> Column:
    """crc32 of an id as text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(text_id.cast("string").cast("binary")) % folds


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without_rows(docs: DataFrame, gone: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """``docs`` without the rows whose scan numbers (monotonically_increasing_id) are in ``gone.rid``;
    ``docs`` must be a table, which Spark deals alike at each scan. Up to ``limit`` numbers (16 MB)
    are broadcast; beyond, the join shuffles."""
    name = free_name(docs, "_row")
    numbered = docs.withColumn(name, F.monotonically_increasing_id())
    return numbered.join(bounded(gone.select(F.col("rid").alias(name)), limit=limit), name, "left_anti").select(*docs.columns)
