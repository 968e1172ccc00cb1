import datetime as dt
import uuid

from pyspark.sql import functions as F

from clickweave.config import delete_path, list_path, shared_root
from clickweave.schema import DEDUP_KEY, DEFAULT_PARAMS, EVENT_COLUMNS, EVENT_SCHEMA
from clickweave.streaming import stream_clean, stream_daily_kpis, stream_table
from clickweave.streaming.complete import (
    _absorb, daily_kpis, read_stream_clean, read_stream_kpis, read_stream_live, read_stream_progress, with_cells)


def _split_source(spark, catalog, parts=4):
    """Raw events as several parquet files, written in event-time order, copies included."""
    root = f"{shared_root(spark)}/test-stream-{uuid.uuid4().hex[:8]}"
    raw = catalog.raw().select(*EVENT_COLUMNS)
    days = raw.select(F.to_date("event_time").alias("d")).distinct().orderBy("d").collect()
    cuts = [days[i * len(days) // parts][0] for i in range(parts)] + [None]
    for i in range(parts):
        part = raw.where(F.to_date("event_time") >= cuts[i])
        if cuts[i + 1] is not None:
            part = part.where(F.to_date("event_time") < cuts[i + 1])
        part.coalesce(1).write.parquet(f"{root}/src/batch={i:02d}")
    return root


def test_stream_dedup_equals_batch_on_keys(spark, catalog):
    root = _split_source(spark, catalog)
    src = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(f"{root}/src")
    q = (stream_clean(src, delay="2 hours").writeStream.format("parquet")
         .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(f"{root}/out").select(*DEDUP_KEY)
    want = catalog.clean().select(*DEDUP_KEY)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _shuffled_source(spark, catalog, files=3):
    root = f"{shared_root(spark)}/test-complete-{uuid.uuid4().hex[:8]}"
    catalog.raw().select(*EVENT_COLUMNS).repartition(files, F.xxhash64("event_time", "price")).write.parquet(f"{root}/src")
    return root


def test_complete_tables_of_unsorted_files(spark, catalog):
    """Files in no time order, one per micro-batch: every row and every payload column of the batch
    table, and every day's KPIs."""
    root = _shuffled_source(spark, catalog)
    src = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/src")
    query = stream_table(src, f"{root}/t", buckets=1).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) > 2
    got, want = read_stream_clean(spark, f"{root}/t"), catalog.clean()
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    days, batch = read_stream_kpis(spark, f"{root}/t"), daily_kpis(want)
    assert days.count() == 92
    assert days.exceptAll(batch).isEmpty() and batch.exceptAll(days).isEmpty()
    late = [r.late_rows for r in read_stream_progress(spark, f"{root}/t").orderBy("batch").collect()]
    assert late[0] == 0 and sum(late) > 1000


def test_live_rows_of_files_in_time_order(spark, catalog):
    """Nothing is late: the live path has every key once, in the batch that brought it, and every batch
    settles only days that it closed."""
    root = _split_source(spark, catalog)
    src = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/src")
    stream_table(src, f"{root}/t", delay=dt.timedelta(hours=2), buckets=1, clean_up=False).trigger(availableNow=True).start().awaitTermination()
    live, want = read_stream_live(spark, f"{root}/t"), catalog.clean()
    keys, all_keys = live.select(*DEDUP_KEY), want.select(*DEDUP_KEY)
    assert keys.exceptAll(all_keys).isEmpty() and all_keys.exceptAll(keys).isEmpty()
    steps = [r for r in read_stream_progress(spark, f"{root}/t").orderBy("batch").collect() if r.n_rows]
    assert [r.late_rows for r in steps] == [0] * 4
    settled = [c for r in steps for c in r.cells]
    assert len(settled) == len(set(settled)) and len({c.event_date for c in settled}) == 91  # each day once; the newest is open
    assert read_stream_clean(spark, f"{root}/t").exceptAll(want).isEmpty()


def _batches(spark, root, batches, **kwargs):
    """Micro-batches, given as lists of rows, through the complete path."""
    for n, rows in batches:
        from helpers import events

        _absorb(with_cells(events(spark, rows), buckets=2), n, root, dt.timedelta(hours=1), DEFAULT_PARAMS, **kwargs)


def test_a_late_row_settles_its_own_cell_alone(spark):
    from helpers import ev

    root = f"{shared_root(spark)}/test-late-cell-{uuid.uuid4().hex[:8]}"
    first = [ev(f"2019-11-{d:02d} 09:00:00", "view", user=u, price=5.0) for d in range(1, 11) for u in "abcd"]
    cheaper = ev("2019-11-03 09:00:00", "view", user="a", price=1.0)  # a copy that the batch table keeps
    _batches(spark, root, [(0, first), (1, [ev("2019-11-12 09:00:00", "view", user="a")]), (2, [cheaper])])
    progress = {r.batch: r for r in read_stream_progress(spark, root).collect()}
    assert {c.event_date.day for c in progress[0].cells} == set(range(1, 10))
    assert {c.event_date.day for c in progress[1].cells} == {10}
    assert [(c.event_date.day, r.late_rows) for r in [progress[2]] for c in r.cells] == [(3, 1)]
    rows = read_stream_clean(spark, root)
    assert rows.count() == 41
    assert [r.price for r in rows.where("user_id = 'a' and event_date = '2019-11-03'").collect()] == [1.0]


def test_a_repeated_micro_batch_changes_nothing(spark):
    from helpers import ev

    root = f"{shared_root(spark)}/test-repeat-{uuid.uuid4().hex[:8]}"
    rows = [ev("2019-11-10 09:00:00", "view", user="a"), ev("2019-11-10 09:00:00", "view", user="a", price=1.0),
            ev("2019-11-12 09:00:00", "purchase", user="b", price=3.0)]
    seen = []
    for batch_id in (0, 0, 1, 1, 2):
        _batches(spark, root, [(batch_id, rows)])
        seen.append((sorted(map(tuple, read_stream_clean(spark, root).collect())), sorted(map(tuple, read_stream_kpis(spark, root).collect()))))
    assert all(s == seen[0] for s in seen) and len(seen[0][0]) == 2
    # a batch that failed before it was committed is taken in anew
    delete_path(spark, f"{root}/state/batch=2")
    _batches(spark, root, [(2, rows)])
    assert sorted(map(tuple, read_stream_clean(spark, root).collect())) == seen[0][0]


def test_used_files_are_removed_and_an_empty_stream_has_empty_tables(spark):
    from helpers import ev

    root = f"{shared_root(spark)}/test-unused-{uuid.uuid4().hex[:8]}"
    assert read_stream_clean(spark, root).count() == read_stream_kpis(spark, root).count() == 0
    _batches(spark, root, [(0, []), *[(d, [ev(f"2019-11-{d:02d} 09:00:00", "view", user=u) for u in "abc"]) for d in range(1, 6)]])
    assert read_stream_clean(spark, root).count() == 15
    assert sorted(list_path(spark, f"{root}/state")) == ["batch=4", "batch=5"]
    assert len([n for n in list_path(spark, f"{root}/arrived") if n.startswith("batch=")]) <= 3
    assert [r.total_events for r in read_stream_kpis(spark, root).orderBy("day").collect()] == [3] * 5


def test_stream_kpis_exact_columns(spark, catalog):
    root = _split_source(spark, catalog, parts=3)
    src = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(f"{root}/src")
    q = (stream_daily_kpis(src, delay="2 hours").writeStream.format("memory").queryName("kpis_test")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("kpis_test")
    batch = (catalog.clean().groupBy("event_date")
             .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("u"),
                  F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("b"),
                  F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("price")).otherwise(0.0)), 2)
                  .alias("rev")))
    joined = got.join(batch, got.day == batch.event_date)
    # every emitted day matches the batch totals; only the newest day is still open
    assert joined.count() == got.count() == batch.count() - 1
    assert joined.where((F.col("total_events") != F.col("n")) | (F.col("unique_users") != F.col("u"))
                        | (F.col("purchasers") != F.col("b"))
                        | (F.abs(F.col("revenue") - F.col("rev")) > 1e-6)).count() == 0


def test_stream_kpis_drop_late_rows(spark):
    import time

    from helpers import ev, events

    root = f"{shared_root(spark)}/test-late-{uuid.uuid4().hex[:8]}"
    # Spark drops rows older than the watermark of the previous micro-batch, so the late row
    # comes two batches after the events that moved the watermark past it.
    batches = [
        [ev("2019-11-10 09:00:00", "view", user="a"), ev("2019-11-10 09:05:00", "purchase", user="a", price=5.0)],
        [ev("2019-11-12 12:00:00", "view", user="b")],                    # closes 2019-11-10
        [ev("2019-11-01 10:00:00", "view", user="late")],                 # older than the watermark
    ]
    for i, rows in enumerate(batches):
        events(spark, rows).coalesce(1).write.parquet(f"{root}/src/b{i}")
        time.sleep(1.1)   # file source orders files by modification time
    src = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(f"{root}/src")
    q = (stream_daily_kpis(src, delay="1 hour").writeStream.format("memory").queryName("kpis_late")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = {r.day: r for r in spark.table("kpis_late").collect()}
    assert set(rows) == {dt.date(2019, 11, 10)}
    r = rows[dt.date(2019, 11, 10)]
    assert (r.total_events, r.unique_users, r.purchasers, r.revenue) == (2, 1, 1, 5.0)


def test_a_cell_is_one_file_however_many_tasks_keep_the_state(spark, catalog):
    """A stream with state runs without adaptive execution; its writes rebalance nevertheless."""
    root = _shuffled_source(spark, catalog, files=2)
    src = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/src")
    stream_table(src, f"{root}/t", buckets=1, clean_up=False).trigger(availableNow=True).start().awaitTermination()
    for folder in ("arrived", "kept"):
        files = spark.read.option("basePath", f"{root}/t/{folder}").parquet(f"{root}/t/{folder}").select(F.input_file_name().alias("f")).distinct()
        per_cell = files.groupBy(F.regexp_replace("f", "/[^/]*$", "").alias("cell")).count()
        assert per_cell.agg(F.max("count")).first()[0] == 1


def test_a_stream_with_live_rows_keeps_no_state_store(spark, catalog):
    """The store held all keys of a batch in the executors' memory."""
    root = _shuffled_source(spark, catalog, files=2)
    src = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/src")
    stream_table(src, f"{root}/t", buckets=1, clean_up=False).trigger(availableNow=True).start().awaitTermination()
    assert list_path(spark, f"{root}/t/checkpoint/state") == []
    assert read_stream_live(spark, f"{root}/t").count() == catalog.clean().count()


def test_live_rows_follow_the_rule_of_the_watermark(spark):
    """A batch drops rows behind the watermark of the batch before it, and keys that were let through after it."""
    from helpers import ev

    root = f"{shared_root(spark)}/test-live-rule-{uuid.uuid4().hex[:8]}"
    old = ev("2019-11-01 09:00:00", "view", user="a")
    _batches(spark, root, [
        (0, [ev("2019-11-10 09:00:00", "view", user="a", session=None), ev("2019-11-10 09:00:00", "view", user="a", session=None, price=1.0)]),
        (1, [old, ev("2019-11-10 09:00:00", "view", user="a", session=None, price=0.5), ev("2019-11-10 08:30:00", "view", user="b")]),
        (2, [{**old, "user_id": "c"}, ev("2019-11-10 08:00:00", "view", user="d"), ev("2019-11-10 08:00:01", "view", user="e"),
             ev("2019-11-10 08:30:00", "view", user="b"), ev("2019-11-10 09:00:00", "view", user="a", session=None)]),
        (3, [ev("2019-11-10 08:00:01", "view", user="e"), ev("2019-11-10 08:00:02", "view", user="f")])], clean_up=False)
    live = [(r.batch, r.user_id, r.event_time.day, r.price) for r in read_stream_live(spark, root).collect()]
    assert sorted(live) == [(0, "a", 10, 1.0), (1, "a", 1, 10.0), (1, "b", 10, 10.0), (2, "e", 10, 10.0), (3, "f", 10, 10.0)]
    assert read_stream_clean(spark, root).count() == 7  # the late rows are in the clean table


def test_a_large_cell_is_cut_into_parts(spark, monkeypatch):
    from helpers import ev, events
    from clickweave.streaming import complete

    root = f"{shared_root(spark)}/test-parts-{uuid.uuid4().hex[:8]}"
    monkeypatch.setattr(complete, "ROW_BYTES", complete.packed_bytes(spark) // 5)  # five rows a part
    rows = [ev("2019-11-10 09:00:00", "view", user="a", product=f"p{i}", price=float(i + 2 + k)) for k in range(2) for i in range(40)]
    extra = [ev("2019-11-12 09:00:00", "purchase", user="a", product=f"p{i}", price=1.0) for i in range(30)]
    cheaper = [ev("2019-11-10 09:00:00", "view", user="a", product=f"p{i}", price=1.0) for i in range(10)]
    _batches(spark, root, [(0, rows), (1, extra), (2, cheaper)])
    cells = with_cells(events(spark, [*rows, *extra[:4]]), buckets=2)
    dealt = complete._dealt(cells, complete._sizes(cells))
    parts = dealt.select(F.spark_partition_id().alias("task"), *complete.CELL, "part", *DEDUP_KEY).distinct()
    assert {r.event_date.day: r.n for r in parts.groupBy("event_date").agg(F.countDistinct("part").alias("n")).collect()} == {10: 16, 12: 1}
    assert parts.count() == 44  # the copies of a key are in one task
    clean = read_stream_clean(spark, root)
    assert sorted((r.product_id, r.price) for r in clean.where("event_type = 'view'").collect()) == sorted(
        (f"p{i}", 1.0 if i < 10 else i + 2.0) for i in range(40))
    assert [tuple(r)[1:] for r in read_stream_kpis(spark, root).orderBy("day").collect()] == [(40, 40, 0, 0, 0.0, 1, 0), (30, 0, 0, 30, 30.0, 1, 1)]


def _plan(df):
    return str(df._jdf.queryExecution().executedPlan())


def test_cells_are_settled_with_one_shuffle_and_one_sort(spark, monkeypatch):
    from helpers import ev
    from pyspark.sql.classic.dataframe import DataFrameWriter

    plans, write = {"arrived": [], "kept": []}, DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        for folder in plans:
            if f"/{folder}/" in path:
                plans[folder].append(_plan(self._df))
        write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    root = f"{shared_root(spark)}/test-one-shuffle-{uuid.uuid4().hex[:8]}"
    _batches(spark, root, [(d, [ev(f"2019-11-{d + 1:02d} 09:00:00", "view", user=u) for u in "abc"]) for d in range(3)])
    assert len(plans["kept"]) == 2 and len(plans["arrived"]) == 3
    for plan in plans["kept"] + plans["arrived"]:
        assert plan.count("Exchange hashpartitioning") == plan.count("Sort [") == 1


def test_superseded_versions_are_not_read(spark):
    """They stay for a batch, as the last state names them."""
    from helpers import ev

    root = f"{shared_root(spark)}/test-versions-{uuid.uuid4().hex[:8]}"
    day = [ev("2019-11-01 09:00:00", "view", user=u) for u in "abc"]
    _batches(spark, root, [(0, [*day, ev("2019-11-03 09:00:00", "view")]), (1, day), (2, day)])
    assert sorted(n for n in list_path(spark, f"{root}/kept") if n.startswith("version=")) == ["version=1", "version=2"]
    filters = [part.split("]")[0] for part in _plan(read_stream_clean(spark, root)).split("PartitionFilters: [")[1:]]
    assert any("version" in f.replace("isnotnull(version", "") for f in filters), filters
