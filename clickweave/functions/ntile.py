"""Exact global n-tiles without a single-partition window.

``NTILE(k) OVER (ORDER BY v)`` with no PARTITION BY makes Spark move every row into one task. Here
the rows are range-partitioned by the whole order (value, then tie-breaks, so that equal values are
dealt to several tasks too), sorted in their tasks, written and numbered (``functions.numbering``).
The number is the global rank, from which the tile follows. Nothing of the data is in the plan: no
boundaries, no counts. Several n-tiles of one table share the count of its parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clickweave.config import delete_path
from clickweave.functions.numbering import part_offsets, with_number, write_numbered


def exact_ntiles(df: DataFrame, k: int, orders: dict[str, Sequence[Column]]) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY ...)`` per name and order. Orders must be total, or rows that tie get
    any of their places. No rows, no tiles."""
    path, ids = None, {out: f"_nt_{i}" for i, out in enumerate(orders)}
    for out, order in orders.items():
        before, (df, path) = path, write_numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), ids[out])
        if before is not None:
            delete_path(df.sparkSession, before)
    offsets = part_offsets(df, list(ids.values()))
    for out, name in ids.items():
        # the first n % k tiles are one row longer
        df = (with_number(df, offsets, name, "_nt_r", "_nt_n")
              .withColumns({"_nt_q": F.expr(f"_nt_n div {k}"), "_nt_e": F.col("_nt_n") % k})
              .withColumn(out, F.expr("cast(if(_nt_r < _nt_e * (_nt_q + 1), _nt_r div (_nt_q + 1),"
                                      " _nt_e + (_nt_r - _nt_e * (_nt_q + 1)) div greatest(_nt_q, 1)) + 1 as int)"))
              .drop("_nt_r", "_nt_n", "_nt_q", "_nt_e"))
    return df


def tile_order(value: str | Column, tiebreak: Sequence[str], ascending: bool = True, nulls_first: bool | None = None) -> list[Column]:
    """The order of an n-tile: NULLs first when ascending and last when descending (the source dialect's
    default), unless ``nulls_first`` says otherwise."""
    v = F.col(value) if isinstance(value, str) else value
    first = ascending if nulls_first is None else nulls_first
    if ascending:
        v = v.asc_nulls_first() if first else v.asc_nulls_last()
    else:
        v = v.desc_nulls_first() if first else v.desc_nulls_last()
    return [v, *[F.col(c).asc_nulls_first() for c in tiebreak]]


def exact_ntile(df: DataFrame, value: str | Column, k: int, out: str, tiebreak: Sequence[str], ascending: bool = True,
                nulls_first: bool | None = None) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY value [DESC], *tiebreak)``; the tie-break ends with a unique key."""
    return exact_ntiles(df, k, {out: tile_order(value, tiebreak, ascending, nulls_first)})
