"""Stored sketches, bitmaps and masks: loaded month by month, replaced, and read without the events."""

import datetime as dt
import math
import random
import re
import uuid

import pytest
from helpers import ev, events

from clickweave.config import list_path, shared_root
from clickweave.functions.numbering import extend_ids
from clickweave.functions.select import percentiles_disc
from clickweave.operators import bitmaps as B, cohort_state as S, price_sketch as Q, sketch as X
from clickweave.operators.clean import clean_events
from clickweave.operators.cohort import cohort_retention
from clickweave.operators.profile import duplicate_keys
from clickweave.schema import DEDUP_KEY, EVENT_COLUMNS
from pyspark.sql import functions as F

KEYS = ["event_month", "category_top"]


def fresh(spark, name):
    return f"{shared_root(spark)}/test-{name}-{uuid.uuid4().hex[:8]}"


def months_of(df):
    return [r[0] for r in df.select("event_month").distinct().orderBy("event_month").collect()]


def local(path):
    return re.sub("^file:/*", "/", path)


def scanned(df):
    return {local(f.split("/part-")[0].split("/event_month=")[0]) for f in df.inputFiles()}


@pytest.fixture(scope="module")
def sketches(spark, catalog):
    path = fresh(spark, "sketches")
    clean = catalog.clean()
    for m in months_of(clean):
        X.store_sketches(clean, path, [m])
    return path


def test_rollups_read_the_store_alone(spark, catalog, sketches):
    store = X.read_sketches(spark, sketches)
    for df in (X.rollup_sketches(store, KEYS), X.funnel_overlaps(store, ["category_top"])):
        assert scanned(df) == {local(sketches)}
    for row in X.sketch_accuracy(catalog.clean(), store, KEYS, within=0.02).collect():
        assert row.users_near and row.viewers_near and row.purchasers_near and row.users > 0
    for row in X.overlap_accuracy(catalog.clean(), store, KEYS, within=0.0).collect():  # small sets: theta sketches are exact
        assert row.viewed_carted_near and row.carted_bought_near and row.viewed_bought_near and row.bought_uncarted_near


def test_a_replaced_month_leaves_the_others(spark, catalog, sketches):
    clean = catalog.clean()
    last = months_of(clean)[-1]
    before = {m: sorted(list_path(spark, f"{sketches}/event_month={m}")) for m in months_of(clean)}
    X.store_sketches(clean, sketches, [last])
    after = {m: sorted(list_path(spark, f"{sketches}/event_month={m}")) for m in months_of(clean)}
    assert all((before[m] == after[m]) == (m != last) for m in before)
    X.store_sketches(clean.where("1 = 0"), sketches, [last])
    assert f"event_month={last}" not in list_path(spark, sketches)
    X.store_sketches(clean, sketches, [last])


def test_bitmaps_add_up_exactly(spark, catalog):
    path, clean = fresh(spark, "bitmaps"), catalog.clean()
    for m in [*months_of(clean), months_of(clean)[0]]:  # the first one again
        B.store_bitmaps(clean, path, path + "_users", [m])
    numbers = spark.read.parquet(path + "_users")
    n = numbers.count()
    assert sorted(r.uid for r in numbers.collect()) == list(range(n)) and numbers.select("user_id").distinct().count() == n
    got = B.distinct_rollup(spark.read.parquet(path), [["category_top"], ["event_month", "brand"], []])
    assert scanned(got) == {local(path)}
    known = B.product_events(clean)
    total = got.where("grain = 'total'").first()
    assert total.users == known.select("user_id").distinct().count() == n
    assert total.purchasers == known.where("event_type = 'purchase'").select("user_id").distinct().count()
    want = known.groupBy("event_month", "brand").agg(F.countDistinct("user_id").alias("n")).collect()
    assert {(r.event_month, r.brand): r.users for r in got.where("grain = 'event_month_brand'").collect()} == {(r.event_month, r.brand): r.n for r in want}


def test_numbers_of_known_keys_stay(spark):
    path = fresh(spark, "ids")
    first = {r.k: r.uid for r in extend_ids(spark, path, spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string")).collect()}
    again = {r.k: r.uid for r in extend_ids(spark, path, spark.createDataFrame([("c",), ("b",), ("d",)], "k string")).collect()}
    assert sorted(first.values()) == [0, 1] and sorted(again.values()) == [0, 1, 2, 3] and all(again[k] == v for k, v in first.items())
    assert {r.k: r.uid for r in extend_ids(spark, path, spark.createDataFrame([("a",)], "k string")).collect()} == again
    assert extend_ids(spark, fresh(spark, "ids"), spark.createDataFrame([], "k string")).count() == 0


def test_masks_loaded_month_by_month_give_the_matrix(spark, catalog):
    path, clean = fresh(spark, "masks"), catalog.clean()
    for m in reversed(months_of(clean)):
        S.store_masks(clean, path, [m])
    got, want = S.retention(S.read_masks(spark, path)), cohort_retention(clean)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 14
    assert "collect_set" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_masks_over_years_and_before_the_origin(spark):
    days = ["1969-12-30", "1970-01-05", "2019-10-01", "2019-10-07", "2021-03-01", "2024-02-29"]
    rows = [ev(f"{d} 10:00:00", "purchase", user=u) for i, d in enumerate(days) for u in ("ab" if i % 2 else "ac")]
    clean = clean_events(events(spark, rows))
    path = fresh(spark, "masks")
    S.store_masks(clean, path)
    got = {(r.cohort_week, r.week_number): r.active_users for r in S.activity(S.read_masks(spark, path)).collect()}
    want, first = {}, {}
    week = lambda d: dt.date.fromisoformat(d) - dt.timedelta(days=dt.date.fromisoformat(d).weekday())
    for i, d in enumerate(days):
        for u in ("ab" if i % 2 else "ac"):
            first.setdefault(u, week(d))
            key = (first[u], (week(d) - first[u]).days // 7)
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_price_quantiles_from_the_store(spark, catalog):
    path, raw = fresh(spark, "prices"), catalog.raw()
    for m in months_of(raw):
        Q.store_prices(raw, path, [m])
    store = spark.read.parquet(path)
    assert scanned(Q.price_quantiles(store)) == {local(path)}
    rows = Q.quantile_accuracy(raw, store).collect()
    assert len(rows) == 4 and all(r.p25_near and r.median_near and r.p75_near for r in rows)


@pytest.mark.parametrize("values", [
    [1.5], [2.0, 2.0, 2.0], [0.1 * i for i in range(500)], [1e308, -1e308, 0.0, 5e-324, 1.0], [math.nan, None, 3.0, math.inf, 1.0],
    [random.Random(5).expovariate(1) ** 9 for _ in range(800)] + [7.0] * 300])
def test_percentiles_by_narrowing(spark, values):
    rows = [(v, 1) for v in values]
    counted = spark.createDataFrame(rows, "value double, n long").groupBy("value").agg(F.sum("n").alias("n"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    s = sorted(v for v in values if v is not None and math.isfinite(v))
    assert percentiles_disc(counted, probs) == [s[max(1, math.ceil(len(s) * p)) - 1] for p in probs]


def test_percentiles_of_nothing(spark):
    assert percentiles_disc(spark.createDataFrame([], "value double, n long"), [0.5]) == [None]


def test_keys_found_by_their_hashes(spark, monkeypatch):
    """Exact also where hashes collide, which makes rare keys look frequent."""
    rnd = random.Random(3)
    rows = [ev(f"2019-10-01 00:00:{rnd.randrange(12):02d}", "cart", user=f"u{int(rnd.paretovariate(1))}", session=rnd.choice(["s", None])) for _ in range(400)]
    raw = events(spark, rows).select(*EVENT_COLUMNS)
    plain = (raw.groupBy(*DEDUP_KEY).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
             .orderBy(F.col("occurrences").desc(), *[F.col(c).asc_nulls_first() for c in DEDUP_KEY]))
    for n in (1, 5, 10_000):
        assert list(map(tuple, duplicate_keys(raw, n).collect())) == list(map(tuple, plain.limit(n).collect()))
    real = F.xxhash64
    monkeypatch.setattr("clickweave.operators.profile.F.xxhash64", lambda *c: F.pmod(real(*c), F.lit(20)))
    for n in (1, 5, 30):
        assert list(map(tuple, duplicate_keys(raw, n).collect())) == list(map(tuple, plain.limit(n).collect()))
