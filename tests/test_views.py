import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickweave.operators.clean import clean_events
from clickweave.operators.cohort import cohort_retention
from clickweave.operators.funnel import funnel
from clickweave.operators.overview import overview
from clickweave.operators.rfm import rfm_segments
from helpers import ev, events


def test_cohort_toy(spark):
    # A buys in weeks 0, 1, 3; B in week 0; C starts in week 1 (weeks start Monday 2019-11-04)
    w = lambda k: dt.datetime(2019, 11, 4, 10) + dt.timedelta(weeks=k)
    rows = [ev(w(0), "purchase", user="A"), ev(w(1), "purchase", user="A"), ev(w(3), "purchase", user="A"),
            ev(w(0) + dt.timedelta(days=6), "purchase", user="B"),   # Sunday, still week 0
            ev(w(1), "purchase", user="C"), ev(w(2), "view", user="C")]
    out = {r.cohort_week: r for r in cohort_retention(clean_events(events(spark, rows))).collect()}
    first, second = out[dt.date(2019, 11, 4)], out[dt.date(2019, 11, 11)]
    assert (first.cohort_users, first.w0, first.w1, first.w2, first.w3) == (2, 100.0, 50.0, None, 50.0)
    assert (second.cohort_users, second.w1, second.w13) == (1, None, None)


@pytest.mark.parametrize("r,f,m,seg", [
    (5, 5, 5, "Champions"), (3, 5, 1, "Loyal"), (4, 1, 4, "High Value New"), (5, 1, 2, "Promising"),
    (2, 5, 5, "At Risk"), (1, 1, 5, "Hibernating"), (3, 1, 5, "Lost"), (1, 1, 1, "Lost")])
def test_segments(spark, r, f, m, seg):
    df = spark.createDataFrame([(r, f, m)], "r_score int, f_score int, m_score int")
    row = rfm_segments(df).first()
    assert row.segment == seg
    assert row.rfm_score == f"{r}{f}{m}"
    assert row.avg_rfm_score == round((r + f + m) / 3.0 + 1e-12, 2)


def test_overview_mom(spark):
    rows = [ev("2019-10-05 10:00:00", "view", user="a"), ev("2019-10-05 10:10:00", "purchase", user="a", price=10.0),
            # November missing entirely; December has no purchases
            ev("2019-12-02 10:00:00", "view", user="a"), ev("2019-12-02 11:00:00", "view", user="b")]
    out = overview(clean_events(events(spark, rows))).orderBy("event_month").collect()
    assert [r.event_month for r in out] == [dt.date(2019, 10, 1), dt.date(2019, 12, 1)]
    oct_, dec = out
    assert oct_.revenue_mom_delta is None and oct_.users_mom_pct is None
    assert dec.revenue == 0.0 and dec.purchase_events is None and dec.purchase_pct is None
    assert dec.revenue_mom_delta == -10.0 and dec.revenue_mom_pct == -100.0
    assert dec.users_mom_delta == 1.0 and dec.users_mom_pct == 100.0
    assert dec.view_pct == 100.0 and dec.cvr == 0.0


def test_funnel_rates_and_nulls(spark):
    rows = [ev("2019-10-01 00:00:00", "view", user="a"), ev("2019-10-01 00:01:00", "cart", user="a"),
            ev("2019-10-01 00:02:00", "purchase", user="b", code=None)]   # buyer without cart or view
    out = {r.row_type: r for r in funnel(clean_events(events(spark, rows))).collect()
           if r.row_type != "CATEGORY_CVR"}
    o = out["Q4_OVERALL"]
    assert (o.users_viewed, o.users_carted, o.users_purchased) == (1, 1, 1)
    assert o.cart_to_purchase_rate == 100.0 and o.view_to_cart_dropoff == 0.0
    cats = [r for r in funnel(clean_events(events(spark, rows))).collect() if r.row_type == "CATEGORY_CVR"]
    assert [c.category_top for c in cats] == ["electronics"]       # 'unknown' excluded


def test_single_month_all_deltas_null(spark):
    rows = [ev("2019-11-01 00:00:00", "view")]
    r = overview(clean_events(events(spark, rows))).first()
    assert all(getattr(r, c) is None for c in ("revenue_mom_delta", "users_mom_delta", "revenue_mom_pct",
                                               "users_mom_pct"))
    assert r.cvr == 0.0 and r.purchasers == 0


def test_cvr_denominators(spark):
    from clickweave.operators.funnel import funnel_category_cvr
    from clickweave.operators.overview import overview_monthly
    from clickweave.operators.product import product_metrics

    rows = [ev("2019-10-01 00:00:00", "view", user="a"), ev("2019-10-01 00:02:00", "purchase", user="a"),
            ev("2019-10-01 00:03:00", "purchase", user="b"), ev("2019-10-01 00:04:00", "cart", user="c")]
    ce = clean_events(events(spark, rows))
    assert funnel_category_cvr(ce).first().category_cvr == round(200 / 3, 2)
    assert funnel_category_cvr(ce, denominator="view").first().category_cvr == 200.0
    assert overview_monthly(ce).first().cvr == 200.0
    assert overview_monthly(ce, denominator="any").first().cvr == round(200 / 3, 2)
    assert product_metrics(ce, denominator="any").first().cvr == round(200 / 3, 2)


def test_period_restriction(spark, catalog):
    from clickweave.schema import Params

    p = Params(period=(dt.date(2019, 11, 1), dt.date(2019, 12, 1)))
    ce = clean_events(catalog.raw(), p)
    months = {r[0] for r in ce.select("event_month").distinct().collect()}
    assert months == {dt.date(2019, 11, 1)}
    plan = ce._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan


def test_fixture_invariants(catalog):
    raw, ce = catalog.raw(), catalog.clean()
    types = {r.event_type: r.n for r in raw.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert sum(types.values()) == raw.count()
    assert types == {"view": 6000, "cart": 1262, "purchase": 310, "remove_from_cart": 23}
    coh = cohort_retention(ce).agg(F.sum("cohort_users")).first()[0]
    buyers = ce.where("event_type = 'purchase'").select("user_id").distinct().count()
    assert coh == buyers == 186


def test_product_revenue_null_and_zero(spark):
    from clickweave.operators.product import product_metrics

    rows = [ev("2019-10-01 00:00:00", "view", user="a", brand="b1"),                    # no purchase: 0, AOV NULL
            ev("2019-10-01 00:01:00", "purchase", user="a", brand="b2", price=None),    # only NULL-price buys
            ev("2019-10-01 00:02:00", "purchase", user="a", brand="b3", price=2.005),
            ev("2019-10-01 00:03:00", "purchase", user="b", brand="b3", price=2.0)]
    out = {r.brand: r for r in product_metrics(clean_events(events(spark, rows))).collect()}
    assert (out["b1"].revenue, out["b1"].avg_order_value, out["b1"].cvr) == (0.0, None, 0.0)
    assert (out["b2"].revenue, out["b2"].avg_order_value, out["b2"].cvr) == (None, None, None)
    assert (out["b3"].revenue, out["b3"].avg_order_value, out["b3"].purchasers) == (4.01, 2.0, 2)


def test_stated_invariants_on_fixture(spark, catalog):
    from clickweave.operators.checks import (
        check_category_clean, check_category_product, check_rfm_recency)

    # product-view revenue never exceeds clean revenue of the same category (unknown brands)
    prod = check_category_product(catalog.product())
    raw = check_category_clean(catalog.clean(), catalog.product())
    both = prod.join(raw, "event_month").collect()
    assert both and all(r.product_view_revenue <= r.raw_revenue + 1e-9 for r in both)
    # a higher recency score never has a longer recency
    rec = {r.r_score: r for r in check_rfm_recency(catalog.rfm()).collect()}
    assert sorted(rec) == [1, 2, 3, 4, 5]
    for s in range(1, 5):
        assert rec[s + 1].max_recency <= rec[s].min_recency
