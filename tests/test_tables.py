import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from clickweave.config import local_path, shared_root
from clickweave.operators.checks import check_month_completeness
from clickweave.operators.clean import clean_events, rebuild_months
from clickweave.operators.profile import duplicate_drilldown, duplicate_keys
from clickweave.schema import EVENT_COLUMNS
from clickweave.sources.tables import write_event_table


def _mtimes(root):
    out = {}
    for d, _, files in os.walk(root):
        for f in files:
            if f.endswith(".parquet"):
                out[os.path.join(d, f)] = os.stat(os.path.join(d, f)).st_mtime_ns
    return out


def test_rebuild_one_month_leaves_others_untouched(spark, catalog):
    path = f"{shared_root(spark)}/test-rebuild-{uuid.uuid4().hex[:8]}"
    raw = catalog.raw()
    write_event_table(clean_events(raw), path)
    before = _mtimes(local_path(path))
    rebuild_months(raw, path, [dt.date(2019, 11, 1)])
    after = _mtimes(local_path(path))
    kept = {f: t for f, t in before.items() if "event_month=2019-11-01" not in f}
    assert kept and all(after.get(f) == t for f, t in kept.items())
    assert any("event_month=2019-11-01" in f and f not in before for f in after)
    got = spark.read.parquet(path)
    assert got.count() == catalog.clean().count()


def test_rebuilding_a_month_without_rows_removes_it(spark, catalog):
    path = f"{shared_root(spark)}/test-empty-month-{uuid.uuid4().hex[:8]}"
    raw = catalog.raw()
    write_event_table(clean_events(raw), path)
    gone = raw.where("event_month <> date'2019-11-01' or event_type = 'remove_from_cart'")
    rebuild_months(gone, path, [dt.date(2019, 11, 1), dt.date(2019, 12, 1)])
    months = {str(r[0]) for r in spark.read.parquet(path).select("event_month").distinct().collect()}
    assert months == {"2019-10-01", "2019-12-01"}


def test_files_per_month_follow_the_data_not_the_tasks(spark, catalog):
    path = f"{shared_root(spark)}/test-files-{uuid.uuid4().hex[:8]}"
    write_event_table(catalog.raw().repartition(16), path)
    files = _mtimes(local_path(path))
    assert len(files) <= 6 and len({os.path.dirname(f) for f in files}) == 3


def test_month_check_prunes_partitions(catalog):
    df = check_month_completeness(catalog.raw(), dt.date(2019, 12, 1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan and "= 2019-12-01" in plan
    r = df.first()
    assert r.first_day == dt.date(2019, 12, 1) and r.last_day <= dt.date(2019, 12, 31) and r.total_rows > 0


def test_drilldown_explicit_and_default(catalog):
    raw = catalog.raw().select(*EVENT_COLUMNS)
    top = duplicate_keys(raw.where("user_id is not null and product_id is not null"), 1).first()
    default = duplicate_drilldown(raw)
    explicit = duplicate_drilldown(raw, top.user_id, top.product_id, top.event_type)
    assert default.exceptAll(explicit).count() == 0 and explicit.exceptAll(default).count() == 0
    assert explicit.agg(F.max("occurrences")).first()[0] == top.occurrences


def test_clustered_layout_reads_few_files_for_a_user(spark, catalog):
    """Ranges of (type, user) inside a month: the files that can hold a user's rows of a type, by their
    statistics, are a few of all."""
    import pyarrow.parquet as pq

    from clickweave.sources.tables import write_clustered

    path = f"{shared_root(spark)}/test-clustered-{uuid.uuid4().hex[:8]}"
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_clustered(catalog.raw(), path)
    for k, v in before.items():
        spark.conf.set(k, v)
    table = spark.read.parquet(path)
    assert table.count() == catalog.raw().count()
    user, kind = table.where("event_type = 'view' and user_id is not null").select("user_id", "event_type").first()
    hit, files = 0, [f.removeprefix("file:").replace("//", "/") for f in table.inputFiles()]
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            u, t = cols["user_id"].statistics, cols["event_type"].statistics
            hit += u.has_min_max and u.min <= user <= u.max and t.min <= kind <= t.max
    assert len(files) >= 24 and 1 <= hit <= len(files) // 3
    used = table.where((F.col("user_id") == user) & (F.col("event_type") == kind)).select("_metadata.file_path").distinct().count()
    assert used <= hit


def test_clean_is_written_with_one_shuffle(spark, catalog):
    from clickweave.operators.clean import clean_events, write_clean

    path = f"{shared_root(spark)}/test-one-shuffle-{uuid.uuid4().hex[:8]}"
    write_clean(catalog.raw(), path, at_once=2)
    got, want = spark.read.parquet(path).select(*catalog.clean().columns), catalog.clean()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = clean_events(catalog.raw()).sortWithinPartitions("event_month", "event_type", "user_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_only_changed_months_are_cleaned_again(spark, catalog):
    from clickweave.operators.clean import month_fingerprints, refresh_clean
    from clickweave.schema import EVENT_COLUMNS

    path = f"{shared_root(spark)}/test-refresh-{uuid.uuid4().hex[:8]}"
    raw = catalog.raw().select(*EVENT_COLUMNS)
    months = refresh_clean(raw, path)
    assert len(months) == 3 and refresh_clean(raw.repartition(7), path) == []
    first = raw.where("event_time < '2019-11-01' and event_type = 'view' and user_id is not null").orderBy("event_time", "product_id").first()
    one = (F.col("event_time") == first.event_time) & (F.col("product_id") == first.product_id) & (F.col("user_id") == first.user_id)
    corrected = raw.withColumn("price", F.when(one, F.lit(1.0)).otherwise(F.col("price")))
    files = {f for f in spark.read.parquet(path).inputFiles()}
    assert refresh_clean(corrected, path) == [months[0]]
    kept = {f for f in spark.read.parquet(path).inputFiles()} & files
    assert {f.split("event_month=")[1][:10] for f in kept} == {str(m) for m in months[1:]}
    assert refresh_clean(corrected.where("event_time < '2019-12-01'"), path) == [months[2]]
    assert spark.read.parquet(path).select("event_month").distinct().count() == 2
    # a row twice differs from the row once, and a NULL in another column is another row
    rows = corrected.limit(1)
    twice = [tuple(month_fingerprints(d).first()) for d in (rows, rows.unionByName(rows), rows.unionByName(rows).unionByName(rows))]
    assert len(set(twice)) == 3


def test_splits_and_shuffle_partitions_are_bounded(spark):
    from clickweave.config import SPLIT_BYTES, bound_tasks

    read, parts = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    s = spark.newSession()
    s.conf.set(read, "128MB")
    s.conf.set("spark.sql.shuffle.partitions", "200")
    bound_tasks(s, 100 << 20)
    assert s.conf.get(read) == str(SPLIT_BYTES) and s.conf.get(parts, None) is None
    bound_tasks(s, 6 << 30)
    assert int(s.conf.get(parts)) == 960  # five times 6 GB in parts of 32 MB
    s.conf.set(read, "1m")
    bound_tasks(s, 1)
    assert s.conf.get(read) == "1m"


def test_a_query_bounds_the_splits_of_its_session(spark):
    from clickweave.config import SPLIT_BYTES
    from clickweave.plans.registry import catalog_for

    s = spark.newSession()
    catalog_for(s, "/root/testdata/sf0.001/")
    assert s.conf.get("spark.sql.files.maxPartitionBytes") == str(SPLIT_BYTES)
    catalog_for(spark, "/root/testdata/sf0.001")


def test_the_events_take_one_join_of_each_table(spark):
    from clickweave.sources.fixtures import commerce_events

    plan = commerce_events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
