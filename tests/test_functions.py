import datetime as dt

from pyspark.sql import functions as F

from clickweave.functions.dims import category_depth, category_top, price_bucket, price_bucket_labels, time_dims
from clickweave.functions.numeric import pct, round_n


def test_price_bucket_edges(spark):
    prices = [-1.0, 0.0, 49.99, 50.0, 199.99, 200.0, 499.99, 500.0, 999.99, 1000.0, None]
    df = spark.createDataFrame([(p,) for p in prices], "price double")
    got = [r[0] for r in df.select(price_bucket(F.col("price"))).collect()]
    assert got == ["0-50", "0-50", "0-50", "50-200", "50-200", "200-500", "200-500", "500-1000",
                   "500-1000", "1000+", "unknown"]
    assert price_bucket_labels((10, 20)) == ["0-10", "10-20", "20+"]


def test_category_edges(spark):
    codes = [None, "", "a", "a.b", "a.b.c.d", ".a", "unknown"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    rows = df.select(category_top(F.col("c")).alias("top"), category_depth(F.col("c")).alias("d")).collect()
    assert [r.top for r in rows] == ["unknown", "", "a", "a", "a", "", "unknown"]
    assert [r.d for r in rows][1:] == [1, 1, 2, 4, 2, 1]


def test_time_dims_utc_edges(spark):
    ts = [dt.datetime(2019, 10, 31, 23, 59, 59), dt.datetime(2019, 11, 1, 0, 0, 0),
          dt.datetime(2019, 11, 10, 12, 0), dt.datetime(2019, 11, 11, 0, 0), dt.datetime(2019, 12, 31, 23, 59, 59)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    rows = df.select(*[c.alias(n) for n, c in time_dims(F.col("t")).items()],
                     F.trunc(F.to_date("t"), "WEEK").alias("wk")).collect()
    assert [r.event_month for r in rows] == [dt.date(2019, 10, 1), dt.date(2019, 11, 1), dt.date(2019, 11, 1),
                                            dt.date(2019, 11, 1), dt.date(2019, 12, 1)]
    assert [r.event_hour for r in rows] == [23, 0, 12, 0, 23]
    assert rows[2].event_day_of_week == "Sunday" and rows[3].event_day_of_week == "Monday"
    # Sunday belongs to the week of the previous Monday
    assert rows[2].wk == dt.date(2019, 11, 4) and rows[3].wk == dt.date(2019, 11, 11)


def test_round_half_up_and_zero_denominator(spark):
    df = spark.createDataFrame([(1.005, 1, 0), (2.675, 3, 3), (0.125, 1, 8)], "x double, a long, b long")
    rows = df.select(round_n(F.col("x"), 2).alias("r"), pct(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.r for r in rows] == [1.01, 2.68, 0.13]
    assert rows[0].p is None and rows[1].p == 100.0 and rows[2].p == 12.5
