import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from clickweave.functions.ntile import exact_ntile, exact_ntiles, tile_order
from clickweave.operators.rfm import rfm, rfm_raw, rfm_scores

TIES = ["_h", "user_id"]


def _builtin(df, value, k, ascending):
    order = F.col(value).asc_nulls_first() if ascending else F.col(value).desc_nulls_last()
    w = Window.orderBy(order, F.col("_h"), F.col("user_id"))
    return {r.user_id: r.t for r in df.select("user_id", F.ntile(k).over(w).alias("t")).collect()}


def _frame(spark, values):
    rows = [(f"u{i}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "user_id string, v double").withColumn("_h", F.md5("user_id"))


def _tiles(df, k, ascending=True):
    return {r.user_id: r.t for r in exact_ntile(df, "v", k, "t", TIES, ascending=ascending).collect()}


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 11])
def test_small_sizes_match_builtin(spark, n):
    df = _frame(spark, [float(i % 3) for i in range(n)])
    assert _tiles(df, 5) == _builtin(df, "v", 5, True)


@pytest.fixture(params=["1", "4", "37"])
def partitions(request, spark):
    """Parts as many as the shuffle setting says: adaptive execution would unite small ones."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield int(request.param)
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ascending", [True, False])
def test_many_parts_and_ties_match_builtin(spark, partitions, ascending):
    rnd = random.Random(7)
    values = [float(rnd.choice([1, 2, 2, 2, 3, 5, 8, 13])) if i % 5 else rnd.random() * 100 for i in range(503)]
    values[10] = values[20] = None
    values[30] = values[31] = float("nan")
    df = _frame(spark, values)
    assert _tiles(df, 5, ascending) == _builtin(df, "v", 5, ascending)


def test_equal_values_are_dealt_to_several_tasks(spark, partitions):
    df = _frame(spark, [4.0] * 300)
    assert _tiles(df, 5) == _builtin(df, "v", 5, True)


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.one_of(st.none(), st.integers(0, 6).map(float), st.floats(0, 50)), max_size=60),
       k=st.integers(1, 7), ascending=st.booleans())
def test_property_equals_builtin_ntile(spark, values, k, ascending):
    df = _frame(spark, values)
    assert _tiles(df, k, ascending) == _builtin(df, "v", k, ascending)


def test_two_orders_share_one_table(spark, partitions):
    rnd = random.Random(9)
    df = _frame(spark, [rnd.random() for _ in range(200)]).withColumn("w", F.crc32("user_id") % 10)
    got = exact_ntiles(df, 4, {"a": tile_order("v", TIES), "b": tile_order("w", TIES, ascending=False)})
    assert got.columns == [*df.columns, "a", "b"]
    assert {r.user_id: r.a for r in got.collect()} == _builtin(df, "v", 4, True)
    assert {r.user_id: r.b for r in got.collect()} == _builtin(df, "w", 4, False)


def test_plan_holds_nothing_of_the_data_and_no_task_holds_all_rows(spark, catalog):
    """The plan is the same whatever the shuffle setting, and has no single-partition exchange."""
    raw, sizes = rfm_raw(catalog.clean()), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("4", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        plan = rfm_scores(raw)._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan
        sizes.append(len(plan.splitlines()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sizes[0] == sizes[1] < 400


def test_rfm_does_not_depend_on_the_parts(spark, catalog, partitions):
    a, b = rfm(catalog.clean()), catalog.rfm()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
