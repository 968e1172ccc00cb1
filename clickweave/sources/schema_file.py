"""Declared schemas: a JSON list of columns with name, type and mode."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession, types as T

#: Type names of schema files.
TYPES = {"STRING": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "DATE": T.DateType(), "FLOAT": T.DoubleType(), "FLOAT64": T.DoubleType(),
         "INTEGER": T.LongType(), "INT64": T.LongType(), "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "NUMERIC": T.DecimalType(38, 9)}
DEFAULT_FILE = Path(__file__).with_name("event_schema.json")


@dataclass(frozen=True)
class DeclaredSchema:
    fields: T.StructType
    required: tuple[str, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.fields.names)


def parse_schema(text: str) -> DeclaredSchema:
    """Columns in file order; a column without a mode is NULLABLE. Unknown types and modes, and columns
    named twice, are errors."""
    fields, required = [], []
    for column in json.loads(text):
        name, kind, mode = column["name"], column["type"].upper(), column.get("mode", "NULLABLE").upper()
        if kind not in TYPES:
            raise ValueError(f"column {name}: unknown type {kind}")
        if mode not in ("NULLABLE", "REQUIRED"):
            raise ValueError(f"column {name}: unknown mode {mode}")
        if name in [f.name for f in fields]:
            raise ValueError(f"column {name} is declared twice")
        fields.append(T.StructField(name, TYPES[kind], mode != "REQUIRED"))
        if mode == "REQUIRED":
            required.append(name)
    return DeclaredSchema(T.StructType(fields), tuple(required))


def read_schema(spark: SparkSession, path: str | None = None) -> DeclaredSchema:
    """The schema in a file of any store that Spark reads (the nine event columns where no file is named)."""
    if path is None:
        return parse_schema(DEFAULT_FILE.read_text())
    return parse_schema(spark.read.text(path, wholetext=True).first()[0])
