"""CSV ingest by a declared schema, with a ledger of loaded files and a quarantine.

All fields are read as strings and the declared types are applied by expressions, so a row is accepted
or rejected for what it holds, whatever columns a query reads of it. Reasons: a wrong number of
fields, a value that its column's type does not take, an empty REQUIRED column. Types and modes come
from a schema file. A file whose header names other columns, or in another order, is refused.

Loading. Every file's rows go to partitions of their own (``event_month``, ``load``; the load is the hash
of the file's path), accepted and rejected ones alike, and the file is entered in the ledger beside
the table (``_loads``) last. So a file in the ledger is not read again, a load repeated after a failure
writes the same partitions anew, and a file that has changed replaces its own rows. Rows count once.

Replay. :func:`replay_quarantine` takes the rejected rows through repair rules and checks them again; those
that pass go to the load ``replay`` of the table, which is written as a whole each time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clickweave.config import delete_path, list_path
from clickweave.schema import CSV_TIME_FORMAT, EVENT_COLUMNS
from clickweave.sources.schema_file import DeclaredSchema, read_schema
from clickweave.sources.tables import MONTH, drop_months, read_event_table, with_month, write_event_table

_CORRUPT = "_corrupt_record"
REJECTED_COLUMNS = (*EVENT_COLUMNS, "raw_record", "reason")
LOAD, REPLAY = "load", "replay"
_LEDGER = "file_path string, file_size long, file_modification_time timestamp"

#: Time formats that a replay tries on a time that did not parse.
REPAIR_TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss")


def _typed(field: T.StructField, value: Column, time_format: str) -> Column:
    if isinstance(field.dataType, T.StringType):
        return value
    if isinstance(field.dataType, T.TimestampNTZType):
        return F.try_to_timestamp(value, F.lit(time_format)).cast(field.dataType)
    return value.try_cast(field.dataType)


def _reason(schema: DeclaredSchema, time_format: str, malformed: Column) -> Column:
    """Why a row of strings is rejected; NULL for rows that are accepted."""
    reason = F.when(malformed, F.lit("malformed_row"))
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            reason = reason.when(F.col(f.name).isNotNull() & _typed(f, F.col(f.name), time_format).isNull(), F.lit(f"bad_{f.name}"))
    for c in schema.required:
        reason = reason.when(F.col(c).isNull(), F.lit(f"missing_{c}"))
    return reason


def _read(spark: SparkSession, paths: Sequence[str], schema: DeclaredSchema, time_format: str) -> DataFrame:
    strings = T.StructType([T.StructField(c, T.StringType(), True) for c in (*schema.names, _CORRUPT)])
    lines = (spark.read.schema(strings).option("header", True).option("enforceSchema", False)
             .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
             .option("columnPruning", False)  # else the number of fields is not checked
             .csv(list(paths)).withColumn(LOAD, F.hex(F.xxhash64("_metadata.file_path"))))
    return lines.withColumn("reason", _reason(schema, time_format, F.col(_CORRUPT).isNotNull()))


def _accepted(tagged: DataFrame, schema: DeclaredSchema, time_format: str) -> DataFrame:
    return tagged.where(F.col("reason").isNull()).select(*[_typed(f, F.col(f.name), time_format).alias(f.name) for f in schema.fields], LOAD)


def _rejected(tagged: DataFrame, schema: DeclaredSchema) -> DataFrame:
    return tagged.where(F.col("reason").isNotNull()).select(*schema.names, F.col(_CORRUPT).alias("raw_record"), "reason", LOAD)


def _files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The files that the paths name; what they hold is not read."""
    found = spark.read.format("binaryFile").load(list(paths))
    return found.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")


def loaded_files(spark: SparkSession, out: str) -> DataFrame:
    """The ledger: every version of every file that has been loaded into ``out``."""
    path = out.rstrip("/") + "_loads"
    if not list_path(spark, path):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(path)


def _forget(spark: SparkSession, root: str, loads: Sequence[str], below_months: bool) -> None:
    """Remove the partitions of loads that are about to be written again."""
    parents = [f"{root}/{m}" for m in list_path(spark, root) if m.startswith(f"{MONTH}=")] if below_months else [root]
    for parent in parents:
        here = set(list_path(spark, parent))
        for load in loads:
            if f"{LOAD}={load}" in here:
                delete_path(spark, f"{parent}/{LOAD}={load}")


def ingest_events(spark: SparkSession, paths: str | Sequence[str], out: str | None = None, time_format: str = CSV_TIME_FORMAT,
                  mode: str = "append", schema: DeclaredSchema | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Load CSV event files. Returns ``(accepted, rejected)``.

    ``schema`` is a declared schema or the path of a schema file. ``accepted`` has its columns, typed.
    ``rejected`` has the fields as read, the raw line where the number of fields is wrong, and a
    ``reason``. With ``out``, the files that the ledger lacks are loaded into the month-partitioned table
    at ``out`` and their rejected rows into ``out + '_rejected'``; ``mode='overwrite'`` loads all files and
    first drops the months that they hold. Each write parses the files once."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not isinstance(schema, DeclaredSchema):
        schema = read_schema(spark, schema)
    if out is None:
        tagged = _read(spark, paths, schema, time_format)
        return _accepted(tagged, schema, time_format).drop(LOAD), _rejected(tagged, schema).drop(LOAD)
    out = out.rstrip("/")
    files = _files(spark, paths)
    if mode == "append":
        files = files.join(loaded_files(spark, out), ["file_path", "file_size", "file_modification_time"], "left_anti")
    new = files.withColumn(LOAD, F.hex(F.xxhash64("file_path"))).collect()  # a row per file
    if new:
        tagged = _read(spark, [unquote(f.file_path) for f in new], schema, time_format)
        accepted = _accepted(tagged, schema, time_format)
        if mode == "overwrite":
            drop_months(spark, out, [r[0] for r in with_month(accepted).select(MONTH).distinct().collect()])
        loads = [f[LOAD] for f in new]
        _forget(spark, out, loads, below_months=True)
        _forget(spark, out + "_rejected", loads, below_months=False)
        # a load's partitions hold one file's rows, which its splits have together: no shuffle would join more
        write_event_table(accepted, out, within=(LOAD,), rebalance=False)
        _rejected(tagged, schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(LOAD).parquet(out + "_rejected")
        spark.createDataFrame([tuple(f)[:3] for f in new], _LEDGER).coalesce(1).write.mode("append").parquet(out + "_loads")
    return read_loaded(spark, out, schema), read_quarantine(spark, out, schema).drop(LOAD)


def read_loaded(spark: SparkSession, out: str, schema: DeclaredSchema | None = None) -> DataFrame:
    """The accepted rows of all loads."""
    schema = schema or read_schema(spark)
    typed = T.StructType([*schema.fields, T.StructField(MONTH, T.DateType()), T.StructField(LOAD, T.StringType())])
    return read_event_table(spark, out, typed).select(*schema.names)


def read_quarantine(spark: SparkSession, out: str, schema: DeclaredSchema | None = None) -> DataFrame:
    """The rejected rows of all loads, with their load."""
    names = (schema or read_schema(spark)).names
    strings = T.StructType([T.StructField(c, T.StringType()) for c in (*names, "raw_record", "reason", LOAD)])
    path = out.rstrip("/") + "_rejected"
    return spark.read.schema(strings).parquet(path) if list_path(spark, path) else spark.createDataFrame([], strings)


# -- replay ---------------------------------------------------------------------------------

Repair = Callable[[DeclaredSchema, str], dict[str, Column]]


def repair_times(schema: DeclaredSchema, time_format: str, formats: Sequence[str] = REPAIR_TIME_FORMATS) -> dict[str, Column]:
    """Times in another of the known formats are written in the declared one."""
    fixed = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            c = F.col(f.name)
            known = F.coalesce(F.try_to_timestamp(c, F.lit(time_format)), *[F.try_to_timestamp(c, F.lit(x)) for x in formats])
            fixed[f.name] = F.coalesce(F.date_format(known, time_format), c)
    return fixed


def repair_numbers(schema: DeclaredSchema, time_format: str) -> dict[str, Column]:
    """Numbers with a decimal comma get a point."""
    number = (T.DoubleType, T.DecimalType)
    return {f.name: F.regexp_replace(F.trim(f.name), r"^(-?[0-9]+),([0-9]+)$", "$1.$2") for f in schema.fields if isinstance(f.dataType, number)}


REPAIRS: tuple[Repair, ...] = (repair_times, repair_numbers)


def replayed(quarantine: DataFrame, schema: DeclaredSchema, time_format: str = CSV_TIME_FORMAT, repairs: Sequence[Repair] = REPAIRS,
             missing_fields: bool = True) -> DataFrame:
    """The quarantine after the repair rules, with the reason that each row is still rejected for
    (``now``; NULL: repaired). Lines with too few fields (as far as they go, the fields are as declared) count
    as whole with the last ones empty, if ``missing_fields``; those with too many stay malformed."""
    fields = F.size(F.split("raw_record", ",")) if missing_fields else F.lit(len(schema.names) + 1)
    malformed = F.col("raw_record").isNotNull() & (fields > len(schema.names))
    for repair in repairs:
        quarantine = quarantine.withColumns(repair(schema, time_format))
    return quarantine.withColumn("now", _reason(schema, time_format, malformed))


def replay_quarantine(spark: SparkSession, out: str, time_format: str = CSV_TIME_FORMAT, schema: DeclaredSchema | str | None = None,
                      repairs: Sequence[Repair] = REPAIRS, missing_fields: bool = True) -> DataFrame:
    """Load the rejected rows of ``out`` that the rules repair, and mark what became of each in
    ``out + '_replayed'`` (the row as it was, and ``now``), which is returned. All repaired rows form one load
    that is written as a whole, so that a second replay changes nothing, and rules can be changed."""
    if not isinstance(schema, DeclaredSchema):
        schema = read_schema(spark, schema)
    out = out.rstrip("/")
    before = read_quarantine(spark, out, schema).withColumn("was", F.struct(*schema.names))
    after = replayed(before, schema, time_format, repairs, missing_fields)
    rows = after.where(F.col("now").isNull()).select(*[_typed(f, F.col(f.name), time_format).alias(f.name) for f in schema.fields], F.lit(REPLAY).alias(LOAD))
    _forget(spark, out, [REPLAY], below_months=True)
    write_event_table(rows, out, within=(LOAD,))
    after.select("was.*", "raw_record", "reason", LOAD, "now").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(out + "_replayed")
    return spark.read.parquet(out + "_replayed")


def export_csv(df: DataFrame, path: str, time_format: str = CSV_TIME_FORMAT) -> None:
    """Write events as header CSV in the ingest format (time as ``… UTC``)."""
    cols = [F.date_format(F.col("event_time"), time_format).alias("event_time")]
    cols += [F.col(c) for c in EVENT_COLUMNS if c != "event_time"]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
