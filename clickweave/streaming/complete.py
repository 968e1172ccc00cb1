"""A stream with two paths: fresh rows at once, and complete tables that lose no late row.

Live path. The first copy of every key ahead of the watermark is let through in the micro-batch that it
arrives in, by the rule of ``dropDuplicatesWithinWatermark``: a batch takes rows after the watermark of
the batch before it, and keys let through after that watermark are known. They are read from the rows set
aside: a state store would hold all keys of a batch in the executors' memory, as the watermark moves between
batches only. Those rows are provisional: a later copy may be the one that the clean table keeps, and rows
behind the watermark are not among them.

Complete path. Every valid row of a micro-batch is set aside under its cell, a day and a hash bucket of
users, and says whether it is live and whether it is the survivor of the batch. Copies share time and user, so
a cell is as independent of all others as a month is. When the watermark has passed a day, its cells are
settled: de-duplicated once and written as a new version. Rows that come later are set aside like any
others, and only their cells are settled again, from the rows kept and the new survivors (of the
survivors of two sets the survivor is that of their union). A batch cleans the cells of the days that it
closes and of its late rows, no month and no other day.

Shuffles. Setting aside and settling shuffle their rows once, by cell; a cell of many rows is cut into parts
by the hash of the key, so that a task holds the same at any size. One sort by cell, type, user and the
rest of the key serves the copies, the folders and the order inside a file.

KPIs. Of each settled cell seven sums are kept: events by type, exact revenue, users, buyers. All rows
of a user and day are in one cell, so users and buyers add up exactly over cells. The KPIs of a day are
the sums of its cells; only cells with rows not yet settled are aggregated when the table is read.

State. ``state/batch=N`` lists the cells (days x buckets rows, which the driver reads): version, batches
with rows set aside, the seven sums. Writing it commits batch N. A batch repeated after a failure
finds its state and changes nothing, or writes the same files again; readers follow the newest state.
Files that neither of the last two states names are removed. ``progress/batch=N`` tells what a batch did.

Defined cases: rows that the clean filter rejects are left out; NULL sessions are one key; an empty batch
only moves the state on; a stream without rows gives empty tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from clickweave.config import delete_path, list_path, packed_bytes
from clickweave.functions.numeric import money, round_n
from clickweave.operators.clean import clean_dedup, clean_filter, enrich
from clickweave.schema import CLEAN_COLUMNS, DEDUP_KEY, DEDUP_ORDER, DEFAULT_PARAMS, EVENT_COLUMNS, EVENT_SCHEMA, Params
from clickweave.streaming.kpis import KPI_COLUMNS

DELAY, BUCKETS = dt.timedelta(hours=1), 16
CELL = ("event_date", "bucket")
#: A cell, its part, and the key: what makes copies, in the order in which rows are written.
_COPIES = (*CELL, "event_type", "user_id", *[c for c in DEDUP_KEY if c not in ("event_type", "user_id")], "part")
#: Bytes of a row in a shuffle, compressed.
ROW_BYTES = 64
SUMS = KPI_COLUMNS[1:]
_CELL_FIELDS = [T.StructField("event_date", T.DateType()), T.StructField("bucket", T.IntegerType())]
_ARRIVED = T.StructType([*EVENT_SCHEMA.fields, T.StructField("live", T.BooleanType()), T.StructField("survivor", T.BooleanType()),
                         T.StructField("batch", T.LongType()), *_CELL_FIELDS])
_KEPT = T.StructType([*EVENT_SCHEMA.fields, T.StructField("version", T.LongType()), *_CELL_FIELDS])
_STATE = T.StructType([
    *_CELL_FIELDS, T.StructField("version", T.LongType()), T.StructField("pending", T.ArrayType(T.LongType())),
    *[T.StructField(c, T.DecimalType(38, 10) if c == "revenue" else T.LongType()) for c in SUMS], T.StructField("newest", T.TimestampNTZType())])
_PROGRESS = "batch long, n_rows long, late_rows long, cells array<struct<event_date: date, bucket: int>>"


@dataclass(frozen=True)
class _Cell:
    version: int | None = None
    pending: tuple[int, ...] = ()
    sums: tuple = (None,) * len(SUMS)


@dataclass
class _State:
    batch: int
    newest: dt.datetime | None
    cells: dict[tuple[dt.date, int], _Cell]


def with_cells(events: DataFrame, buckets: int = BUCKETS, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Every valid row with its cell."""
    return clean_filter(events.select(*EVENT_COLUMNS), params.events).withColumns({
        "event_date": F.to_date("event_time"), "bucket": F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")})


def _dealt(rows: DataFrame, sizes: dict[tuple[dt.date, int], int]) -> DataFrame:
    """``rows`` shuffled by cell, and by ``part`` where a cell has more of them than adaptive execution packs into a task.
    Copies stay together. ``sizes`` (days x buckets, a broadcast of those that are cut) need not be exact."""
    most = max(1, packed_bytes(rows.sparkSession) // ROW_BYTES)
    cut = [(*k, -(-n // most)) for k, n in sizes.items() if n > most]
    if not cut:
        return rows.withColumn("part", F.lit(0)).repartition(*CELL)
    parts = rows.sparkSession.createDataFrame(cut, T.StructType([*_CELL_FIELDS, T.StructField("parts", T.LongType())]))
    part = F.pmod(F.xxhash64(*DEDUP_KEY), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(parts), list(CELL), "left").withColumn("part", part).drop("parts").repartition(*CELL, "part")


def _sizes(rows: DataFrame) -> dict[tuple[dt.date, int], int]:
    return {(r.event_date, r.bucket): r["n"] for r in rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).collect()}


def _sums(kept: DataFrame, keys: Iterable[str], params: Params) -> DataFrame:
    """The seven sums by ``keys``, which must hold all rows of a user and day together or the day. First per
    user, so that a busy day is pre-aggregated."""
    keys, names, t = list(keys), params.events, F.col("event_type")
    per_user = kept.groupBy(*keys, "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t == names.view).alias("nv"), F.count_if(t == names.cart).alias("nc"),
        F.count_if(t == names.purchase).alias("np"),
        F.sum(money(F.when(t == names.purchase, F.col("price")).otherwise(F.lit(0.0)))).alias("rev"))
    return per_user.groupBy(*keys).agg(
        F.sum("n").alias("total_events"), F.sum("nv").alias("view_events"), F.sum("nc").alias("cart_events"),
        F.sum("np").alias("purchase_events"), F.coalesce(F.sum("rev"), F.lit(0)).cast("decimal(38,10)").alias("revenue"),
        F.count(F.lit(1)).alias("unique_users"), F.count_if(F.col("np") > 0).alias("purchasers"))


def daily_kpis(clean: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Per day: events by type, purchase revenue, distinct users and buyers (exact)."""
    days = _sums(clean, ["event_date"], params)
    return days.withColumn("revenue", round_n(F.col("revenue"), 2)).withColumnRenamed("event_date", "day").select(*KPI_COLUMNS)


# -- state ----------------------------------------------------------------------------------

def _newest_state(spark: SparkSession, root: str, below: float = float("inf")) -> int:
    found = [int(n.removeprefix("batch=")) for n in list_path(spark, f"{root}/state") if n.startswith("batch=")]
    return max((n for n in found if n < below), default=-1)


def _state(spark: SparkSession, root: str, batch: int) -> _State:
    found = _State(batch, None, {})
    if batch >= 0:
        for r in spark.read.schema(_STATE).parquet(f"{root}/state/batch={batch}").collect():
            if r.event_date is None:
                found.newest = r.newest
            else:
                found.cells[(r.event_date, r.bucket)] = _Cell(r.version, tuple(r.pending), tuple(r[c] for c in SUMS))
    return found


def _commit(spark: SparkSession, root: str, state: _State) -> None:
    """One file, so that the state is there as a whole or not at all."""
    rows = [(None, None, None, [], *[None] * len(SUMS), state.newest)]
    rows += [(*k, c.version, list(c.pending), *c.sums, None) for k, c in state.cells.items()]
    spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{root}/state/batch={state.batch}")


def _cell_paths(base: str, cells: Iterable[tuple[dt.date, int]]) -> list[str]:
    return [f"{base}/event_date={d}/bucket={b}" for d, b in cells]


def _rows_of(spark: SparkSession, base: str, schema: T.StructType, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*paths)


def _united(spark: SparkSession, root: str, state: _State, cells: list[tuple[dt.date, int]]) -> DataFrame:
    """The rows of cells, de-duplicated and in the order of _COPIES: those kept and the survivors set aside since."""
    kept = [p for k in cells if (v := state.cells[k].version) is not None for p in _cell_paths(f"{root}/kept/version={v}", [k])]
    aside = [p for k in cells for b in state.cells[k].pending for p in _cell_paths(f"{root}/arrived/batch={b}", [k])]
    columns = [*EVENT_COLUMNS, *CELL]
    both = _rows_of(spark, f"{root}/kept", _KEPT, kept).select(*columns).unionByName(
        _rows_of(spark, f"{root}/arrived", _ARRIVED, aside).where("survivor").select(*columns))
    return clean_dedup(_dealt(both, _sizes(both)), _COPIES).select(*columns)


def _settle(spark: SparkSession, root: str, state: _State, due: list[tuple[dt.date, int]], params: Params) -> None:
    version = state.batch
    path = f"{root}/kept/version={version}"
    _united(spark, root, state, due).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*CELL).parquet(path)
    for r in _sums(spark.read.schema(_KEPT).option("basePath", f"{root}/kept").parquet(path), CELL, params).collect():  # a row per cell
        state.cells[(r.event_date, r.bucket)] = _Cell(version, (), tuple(r[c] for c in SUMS))


def _remove_unused(spark: SparkSession, root: str, states: Iterable[_State]) -> None:
    """Versions, batches and states that none of ``states`` names."""
    states = list(states)
    keep = {"kept/version=": {c.version for s in states for c in s.cells.values()},
            "arrived/batch=": {b for s in states for c in s.cells.values() for b in c.pending} | {s.batch for s in states},
            "state/batch=": {s.batch for s in states}}
    for prefix, used in keep.items():
        folder, name = prefix.split("/")
        for found in list_path(spark, f"{root}/{folder}"):
            if found.startswith(name) and int(found.removeprefix(name)) not in used:
                delete_path(spark, f"{root}/{folder}/{found}")


@contextmanager
def _adaptive(spark: SparkSession) -> Iterator[None]:
    """Spark may turn adaptive execution off in the session of a stream, and with it the packing of small
    partitions before a write. A batch keeps no state in Spark."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _absorb(batch: DataFrame, batch_id: int, root: str, delay: dt.timedelta, params: Params, clean_up: bool = True) -> None:
    """Take in a micro-batch of :func:`with_cells`."""
    with _adaptive(batch.sparkSession):
        _take_in(batch, batch_id, root, delay, params, clean_up)


def _after(time: dt.datetime | None) -> Column:
    """Whether a row is ahead of the watermark ``time``; all are, of none."""
    return F.lit(True) if time is None else F.col("event_time") > F.lit(time.isoformat(" ")).cast("timestamp_ntz")


def _known(spark: SparkSession, root: str, last: int, earlier: _State, ahead: dt.datetime | None) -> DataFrame:
    """The keys let through ahead of the watermark ``ahead``, that of state ``earlier``: their days were open in that state, so
    that it names their batches, or they came with the batch ``last`` after it."""
    open_cells = [k for k in earlier.cells if ahead is None or k[0] >= ahead.date()]
    paths = [p for k in open_cells for b in earlier.cells[k].pending for p in _cell_paths(f"{root}/arrived/batch={b}", [k])]
    rows = _rows_of(spark, f"{root}/arrived", _ARRIVED, [*paths, f"{root}/arrived/batch={last}"]).where("live").where(_after(ahead))
    if ahead is not None:
        rows = rows.where(F.col("event_date") >= F.lit(ahead.date()))
    others = [F.lit(None).cast(EVENT_SCHEMA[c].dataType).alias(c) for c in EVENT_COLUMNS if c not in DEDUP_KEY]
    return rows.select(*DEDUP_KEY, *others, *CELL, F.lit(True).alias("known"))


def _set_aside(batch: DataFrame, root: str, path: str, last: int, delay: dt.timedelta) -> None:
    """Write the rows of a micro-batch by cell. ``survivor``: the copy of the batch that the clean table would keep;
    ``live``: a survivor ahead of the watermark whose key is not known."""
    spark = batch.sparkSession
    earlier = _state(spark, root, _newest_state(spark, root, below=last))
    ahead = None if earlier.newest is None else earlier.newest - delay
    rows = batch.select(*EVENT_COLUMNS, *CELL, F.lit(False).alias("known"))
    sizes = _sizes(rows)
    if last >= 0:
        rows = rows.unionByName(_known(spark, root, last, earlier, ahead))
    copies = Window.partitionBy(*_COPIES).orderBy(F.col("known").desc(), *[F.col(c).asc_nulls_first() for c in DEDUP_ORDER])
    before = F.first("known").over(copies.rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a key is known once
    placed = _dealt(rows, sizes).withColumns({"before": before, "place": F.row_number().over(copies)}).where(~F.col("known"))
    survivor = F.col("place") == F.when(F.col("before"), 2).otherwise(1)
    marked = placed.select(*EVENT_COLUMNS, (survivor & ~F.col("before") & _after(ahead)).alias("live"), survivor.alias("survivor"), *CELL)
    marked.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*CELL).parquet(path)


def _take_in(batch: DataFrame, batch_id: int, root: str, delay: dt.timedelta, params: Params, clean_up: bool) -> None:
    spark = batch.sparkSession
    last = _newest_state(spark, root)
    if last >= batch_id:
        return
    before = _state(spark, root, last)
    state = _State(batch_id, before.newest, dict(before.cells))
    path = f"{root}/arrived/batch={batch_id}"
    _set_aside(batch, root, path, last, delay)
    late = ~_after(None if before.newest is None else before.newest - delay)
    arrived = spark.read.schema(_ARRIVED).option("basePath", f"{root}/arrived").parquet(path)
    touched = arrived.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"), F.max("event_time").alias("newest")).collect()
    for r in touched:
        cell = state.cells.get((r.event_date, r.bucket), _Cell())
        state.cells[(r.event_date, r.bucket)] = replace(cell, pending=(*cell.pending, batch_id))
        state.newest = r.newest if state.newest is None else max(state.newest, r.newest)
    due: list[tuple[dt.date, int]] = []
    if state.newest is not None:
        open_day = (state.newest - delay).date()
        due = [k for k, c in state.cells.items() if c.pending and k[0] < open_day]
    if due:
        _settle(spark, root, state, due, params)
    spark.createDataFrame([(batch_id, sum(r.n for r in touched), sum(r.late for r in touched), due)], _PROGRESS).coalesce(1).write.mode(
        "overwrite").parquet(f"{root}/progress/batch={batch_id}")
    _commit(spark, root, state)
    if clean_up:
        _remove_unused(spark, root, (before, state))


def stream_table(events: DataFrame, root: str, delay: dt.timedelta = DELAY, buckets: int = BUCKETS, params: Params = DEFAULT_PARAMS,
                 clean_up: bool = True):
    """A writer (set a trigger and start it) that keeps live rows, the clean table and daily KPIs of all
    rows seen under ``root``. A batch's live rows stay until its days are settled. ``events`` are read twice a batch."""
    def absorb(batch: DataFrame, batch_id: int) -> None:
        _absorb(batch, batch_id, root, delay, params, clean_up)

    return with_cells(events, buckets, params).writeStream.foreachBatch(absorb).option("checkpointLocation", f"{root}/checkpoint")


# -- reading --------------------------------------------------------------------------------

def _settled(spark: SparkSession, root: str, state: _State) -> DataFrame:
    """The rows of all cells that have none set aside. The list of cells has days x buckets rows."""
    cells = [(*k, c.version) for k, c in state.cells.items() if not c.pending]
    if not cells:
        return spark.createDataFrame([], _KEPT).select(*EVENT_COLUMNS)
    wanted = spark.createDataFrame(cells, T.StructType([*_CELL_FIELDS, T.StructField("version", T.LongType())]))
    versions = {v for *_, v in cells}  # prunes folders; the join alone would read those of the last state, too
    kept = spark.read.schema(_KEPT).parquet(f"{root}/kept").where(F.col("version").isin(versions))
    return kept.join(F.broadcast(wanted), [*CELL, "version"], "left_semi").select(*EVENT_COLUMNS)


def _unsettled(spark: SparkSession, root: str, state: _State) -> DataFrame:
    return _united(spark, root, state, [k for k, c in state.cells.items() if c.pending])


def read_stream_clean(spark: SparkSession, root: str, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """The clean table of all rows seen."""
    state = _state(spark, root, _newest_state(spark, root))
    return enrich(_settled(spark, root, state).unionByName(_unsettled(spark, root, state).select(*EVENT_COLUMNS)), params).select(*CLEAN_COLUMNS)


def read_stream_live(spark: SparkSession, root: str, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """The provisional rows of the batches that are not removed yet."""
    arrived = spark.read.schema(_ARRIVED).parquet(f"{root}/arrived").where("live")
    return enrich(arrived.drop("event_date"), params, keep=["batch"])


def read_stream_kpis(spark: SparkSession, root: str, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """The daily KPIs of all rows seen: sums over settled cells, and the unsettled cells aggregated now."""
    state = _state(spark, root, _newest_state(spark, root))
    known = [(k[0], *c.sums) for k, c in state.cells.items() if not c.pending]
    schema = T.StructType([_STATE["event_date"], *[_STATE[c] for c in SUMS]])
    sums = spark.createDataFrame(known, schema).unionByName(_sums(_unsettled(spark, root, state), CELL, params).drop("bucket"))
    days = sums.groupBy(F.col("event_date").alias("day")).agg(*[F.sum(c).alias(c) for c in SUMS])
    return days.withColumn("revenue", round_n(F.col("revenue"), 2)).select(*KPI_COLUMNS)


def read_stream_progress(spark: SparkSession, root: str) -> DataFrame:
    """Per batch: rows, late rows, and the cells that it settled."""
    return spark.read.schema(_PROGRESS).parquet(f"{root}/progress")
