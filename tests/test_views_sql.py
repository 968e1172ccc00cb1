import uuid

from clickweave.config import scale_conf, shared_root
from clickweave.plans.views import VIEWS, export_views, register_views


def test_register_and_query_views(spark, catalog):
    names = register_views(catalog)
    assert set(names) == set(VIEWS)
    n = spark.sql("select count(*) from vw_clean_events").first()[0]
    assert n == catalog.clean().count()
    seg = spark.sql("select segment, count(*) c from vw_rfm group by segment").collect()
    assert sum(r.c for r in seg) == spark.sql("select count(*) from vw_rfm").first()[0]


def test_export_views(spark, catalog):
    out = f"{shared_root(spark)}/test-serving-{uuid.uuid4().hex[:8]}"
    paths = export_views(catalog, out, ["vw_overview", "vw_cohort"])
    assert spark.read.parquet(paths["vw_overview"]).count() == 3
    assert spark.read.parquet(paths["vw_cohort"]).count() == 14


def test_scale_conf():
    conf = scale_conf(100 * 2**40, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"]) == 16


def test_catalog_over_existing_table(spark, catalog):
    from clickweave.operators.funnel import funnel
    from clickweave.plans.catalog import EventCatalog

    cat = EventCatalog.over_table(spark, catalog.raw_path())
    assert cat.raw_path() == catalog.raw_path()
    assert cat.clean().count() == catalog.clean().count()
    a, b = funnel(cat.clean()), funnel(catalog.clean())
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_command_line(spark, catalog):
    from clickweave.__main__ import main
    from clickweave.sources.ingest import export_csv

    root = f"{shared_root(spark)}/test-cli-{uuid.uuid4().hex[:8]}"
    export_csv(catalog.raw().drop("event_month"), f"{root}/csv")
    report = main(["--csv", f"{root}/csv", "--out", f"{root}/out", "--views", "vw_overview", "vw_funnel"])
    assert report["rejected"] == 0
    assert spark.read.parquet(report["views"]["vw_overview"]).count() == 3
    assert spark.read.parquet(f"{root}/out/clean").count() == catalog.clean().count()
    # rebuild one month in place
    main(["--raw", f"{root}/out/raw", "--out", f"{root}/out", "--months", "2019-12-01", "--views", "vw_cohort"])
    assert spark.read.parquet(f"{root}/out/clean").count() == catalog.clean().count()
