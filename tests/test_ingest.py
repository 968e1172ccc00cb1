import uuid

import pytest

from clickweave.config import shared_root
from clickweave.sources.ingest import export_csv, ingest_events
from clickweave.sources.tables import read_event_table, raw_table_schema

HEADER = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
GOOD = "2019-11-17 16:58:15 UTC,cart,4711,205,audio.headphone,acme,244.02,u77,s1\n"


def _write(spark, text):
    path = f"{shared_root(spark)}/test-ingest-{uuid.uuid4().hex[:8]}"
    local = path[len("file:"):] if path.startswith("file:") else path
    import os
    os.makedirs(local, exist_ok=True)
    with open(f"{local}/part.csv", "w") as f:
        f.write(text)
    return path


BAD = [
    (",view,1,2,a.b,x,1.0,u,s\n", "missing_event_time"),
    ("2019-11-17 16:58:15 UTC,,1,2,a.b,x,1.0,u,s\n", "missing_event_type"),
    ("2019-13-45 99:00:00 UTC,view,1,2,a.b,x,1.0,u,s\n", "bad_event_time"),
    ("2019-11-17 16:58:15 UTC,view,1,2,a.b,x,abc,u,s\n", "bad_price"),
    ("2019-11-17 16:58:15 UTC,view,1,2\n", "malformed_row"),
    ("2019-11-17 16:58:15 UTC,view,1,2,a.b,x,1.0,u,s,more\n", "malformed_row"),
]


def test_rejects_with_reasons(spark):
    path = _write(spark, HEADER + GOOD + "".join(b for b, _ in BAD))
    accepted, rejected = ingest_events(spark, path)
    acc = accepted.collect()
    assert len(acc) == 1 and acc[0].price == 244.02 and acc[0].user_id == "u77"
    assert str(acc[0].event_time) == "2019-11-17 16:58:15"
    rej = rejected.collect()
    assert sorted(r.reason for r in rej) == sorted(reason for _, reason in BAD)
    assert sorted(r.raw_record for r in rej if r.reason == "malformed_row") == sorted(b.strip() for b, r in BAD if r == "malformed_row")


def test_row_sets_do_not_depend_on_the_columns_read(spark):
    path = _write(spark, HEADER + GOOD + "".join(b for b, _ in BAD))
    accepted, rejected = ingest_events(spark, path)
    assert accepted.count() == 1 and rejected.count() == len(BAD)
    assert all(len(accepted.select(c).collect()) == 1 for c in accepted.columns)
    assert all(len(rejected.select(c).collect()) == len(BAD) for c in rejected.columns)
    assert [tuple(r) for r in accepted.groupBy("event_type").count().collect()] == [("cart", 1)]


def test_a_reordered_header_is_refused(spark):
    names = HEADER.strip().split(",")
    path = _write(spark, ",".join([names[-1], *names[:-1]]) + "\n" + GOOD)
    for read in (lambda df: df.count(), lambda df: df.select("brand").collect()):
        with pytest.raises(Exception, match="header"):
            read(ingest_events(spark, path)[0])


def test_a_second_file_of_a_month_is_added(spark):
    out = f"{shared_root(spark)}/test-append-{uuid.uuid4().hex[:8]}"
    first, rejected = ingest_events(spark, _write(spark, HEADER + GOOD + BAD[0][0]), out=out)
    second, rejected = ingest_events(spark, _write(spark, HEADER + GOOD.replace("-17 ", "-18 ") + BAD[1][0]), out=out)
    assert sorted(str(r.event_time.date()) for r in second.collect()) == ["2019-11-17", "2019-11-18"]
    assert rejected.count() == 2
    only, _ = ingest_events(spark, _write(spark, HEADER + GOOD.replace("-17 ", "-19 ")), out=out, mode="overwrite")
    assert [str(r.event_time.date()) for r in only.collect()] == ["2019-11-19"]


def test_round_trip_and_partitioned_write(spark, catalog):
    raw = catalog.raw().select(*[f.name for f in raw_table_schema().fields][:9])
    path = f"{shared_root(spark)}/test-roundtrip-{uuid.uuid4().hex[:8]}"
    export_csv(raw, path + "/csv")
    accepted, rejected = ingest_events(spark, path + "/csv", out=path + "/table")
    assert rejected.count() == 0
    assert accepted.exceptAll(raw).count() == 0 and raw.exceptAll(accepted).count() == 0
    table = read_event_table(spark, path + "/table", raw_table_schema())
    months = sorted(r[0] for r in table.select("event_month").distinct().collect())
    assert [str(m) for m in months] == ["2019-10-01", "2019-11-01", "2019-12-01"]


def test_gzip_csv(spark, catalog):
    raw = catalog.raw().select(*[f.name for f in raw_table_schema().fields][:9])
    path = f"{shared_root(spark)}/test-gzip-{uuid.uuid4().hex[:8]}"
    from pyspark.sql import functions as F

    from clickweave.schema import CSV_TIME_FORMAT
    cols = [F.date_format("event_time", CSV_TIME_FORMAT).alias("event_time"), *raw.columns[1:]]
    raw.select(*cols).write.option("header", True).option("compression", "gzip").csv(path)
    accepted, rejected = ingest_events(spark, path)
    assert rejected.count() == 0 and accepted.count() == raw.count()


def test_broken_lines_are_written_by_several_tasks_under_a_header_each(spark, tmp_path):
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from clickweave.plans.registry import _planted_csv
    from clickweave.schema import EVENT_COLUMNS

    n = 200
    raw = spark.range(0, n, 1, 4).select(
        F.timestamp_seconds(F.lit(1575000000) + F.col("id")).alias("event_time"), F.lit("view").alias("event_type"),
        (F.col("id") * 37).cast("string").alias("product_id"), F.lit("7").alias("category_id"), F.lit("a.b").alias("category_code"),
        F.lit(' "x y" ').alias("brand"), F.lit(1.5).alias("price"), F.col("id").cast("string").alias("user_id"), F.lit("s ").alias("user_session"))
    _planted_csv(SimpleNamespace(raw=lambda: raw, spark=spark), str(tmp_path / "csv"))
    files = [p.read_text().split("\n")[:-1] for p in (tmp_path / "csv" / "bad").glob("part-*")]
    assert len(files) == 4 and all(f[0] == ",".join(EVENT_COLUMNS) and len(f) > 1 for f in files)
    lines = sorted((x for f in files for x in f[1:]), key=lambda x: int(x.split(",")[2]))
    assert len(lines) == n
    assert lines[1].endswith(',view,37,7,a.b, "x y" ,dear,1,s ') and lines[0].startswith("not a time,view,0,") and lines[3].startswith(",view,111,")
    assert lines[2].endswith(",view,74,7,a.b") and ",,148,7," in lines[4]


def test_schema_files(spark):
    from clickweave.schema import EVENT_SCHEMA, REQUIRED_COLUMNS
    from clickweave.sources.schema_file import parse_schema, read_schema

    declared = read_schema(spark)
    assert declared.fields == EVENT_SCHEMA and declared.required == REQUIRED_COLUMNS
    for bad in ('[{"name": "a", "type": "MAP"}]', '[{"name": "a", "type": "STRING", "mode": "REPEATED"}]',
                '[{"name": "a", "type": "STRING"}, {"name": "a", "type": "DATE"}]'):
        with pytest.raises(ValueError):
            parse_schema(bad)


def test_a_changed_mode_changes_what_is_rejected(spark):
    from clickweave.sources.schema_file import DEFAULT_FILE

    rows = HEADER + GOOD + "2019-11-17 16:58:15 UTC,view,1,2,a.b,x,1.0,,s\n,view,1,2,a.b,x,1.0,u,s\n"
    path = _write(spark, rows)
    other = _write(spark, DEFAULT_FILE.read_text().replace('"event_time", "type": "TIMESTAMP", "mode": "REQUIRED"', '"event_time", "type": "TIMESTAMP"')
                   .replace('"user_id", "type": "STRING", "mode": "NULLABLE"', '"user_id", "type": "STRING", "mode": "REQUIRED"'))
    assert [r.reason for r in ingest_events(spark, path)[1].collect()] == ["missing_event_time"]
    assert [r.reason for r in ingest_events(spark, path, schema=other + "/part.csv")[1].collect()] == ["missing_user_id"]


def test_a_file_counts_once(spark):
    """Loaded twice, loaded again after a failure before it was entered, and replaced by another version."""
    from clickweave.config import delete_path
    from clickweave.sources.ingest import loaded_files

    path, second = _write(spark, HEADER + GOOD + BAD[0][0]), _write(spark, HEADER + GOOD.replace("2019-11", "2019-12"))
    out = f"{shared_root(spark)}/test-ledger-{uuid.uuid4().hex[:8]}"
    for _ in range(2):
        accepted, rejected = ingest_events(spark, path, out=out)
        assert (accepted.count(), rejected.count()) == (1, 1)
    assert ingest_events(spark, [path, second], out=out)[0].count() == 2 and loaded_files(spark, out).count() == 2
    delete_path(spark, out + "_loads")
    accepted, rejected = ingest_events(spark, [path, second], out=out)
    assert (accepted.count(), rejected.count()) == (2, 1)
    with open((path[len("file:"):] if path.startswith("file:") else path) + "/part.csv", "w") as f:
        f.write(HEADER + GOOD.replace("2019-11", "2019-10") * 3)
    accepted, rejected = ingest_events(spark, [path, second], out=out)
    assert sorted(r.event_time.month for r in accepted.collect()) == [10, 10, 10, 12] and rejected.count() == 0
    assert ingest_events(spark, path, out=out, mode="overwrite")[0].count() == 4


def test_replay_loads_repaired_rows_once(spark):
    from clickweave.sources.ingest import read_loaded, replay_quarantine

    fixable = ["2019-11-17T16:58:15Z,view,1,2,a.b,x,1.0,u,s\n", "17.11.2019 16:58:15,view,2,2,a.b,x,1.0,u,s\n", '2019-11-17 16:58:15 UTC,view,3,2,a.b,x,"1,5",u,s\n',
               "2019-11-17 16:58:15 UTC,view,4,2,a.b,x,1.0,u\n", '2019-11-17T16:58:15Z,view,5,2,a.b,x,"-2,25"\n']
    path = _write(spark, HEADER + GOOD + "".join(fixable) + "".join(b for b, _ in BAD))
    out = f"{shared_root(spark)}/test-replay-{uuid.uuid4().hex[:8]}"
    ingest_events(spark, path, out=out)
    for _ in range(2):
        marks = replay_quarantine(spark, out).collect()
    rows = {r.product_id: r for r in read_loaded(spark, out).collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "4711", "5"] or sorted(rows) == ["1", "1", "2", "3", "4", "4711", "5"]
    assert len({r.event_time for r in rows.values()}) == 1 and rows["3"].price == 1.5 and rows["4"].user_session is None and rows["5"].price == -2.25
    assert sorted((m.reason, m.now) for m in marks if m.now) == sorted([("missing_event_time",) * 2, ("missing_event_type",) * 2, ("bad_event_time",) * 2,
                                                                      ("bad_price",) * 2, ("malformed_row",) * 2])
    assert sum(m.now is None for m in marks) == 6  # a line of four fields is whole with the others empty
    assert read_loaded(spark, out).count() == 7


def test_a_load_is_written_without_a_shuffle(spark, monkeypatch):
    """Partitions are of one file each, so that a shuffle would only move its rows."""
    from clickweave.sources import ingest

    path = _write(spark, HEADER + GOOD * 50)
    out = f"{shared_root(spark)}/test-load-{uuid.uuid4().hex[:8]}"
    sc, group, write = spark.sparkContext, uuid.uuid4().hex, ingest.write_event_table

    def grouped(*args, **kwargs):
        sc.setJobGroup(group, "load")
        try:
            write(*args, **kwargs)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    monkeypatch.setattr(ingest, "write_event_table", grouped)
    ingest_events(spark, path, out=out)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    assert jobs and max(len(j.stageIds) for j in jobs) == 1
    assert read_event_table(spark, out, raw_table_schema()).count() == 50
