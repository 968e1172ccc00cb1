"""The fixture's measured figures (FIXTURES.md §3) at sf0.01, end to end through the library."""

import pytest
from pyspark.sql import functions as F

from clickweave.operators.funnel import funnel_overall
from clickweave.operators.product import product_metrics
from clickweave.operators.rfm import rfm

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cat(spark):
    from clickweave.plans.registry import catalog_for

    return catalog_for(spark, SF)


def test_raw_and_clean_counts(cat):
    raw = cat.raw()
    assert raw.count() == 76_164
    types = {r.event_type: r.n for r in raw.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert types == {"view": 60_000, "cart": 13_221, "purchase": 2_739, "remove_from_cart": 204}
    assert cat.clean().count() == 66_263
    repeated = raw.groupBy("event_time", "event_type", "user_id", "user_session", "product_id").count()
    assert repeated.where("count > 1").count() == 1_543


def test_funnel_and_products(cat):
    o = funnel_overall(cat.clean()).first()
    assert (o.users_viewed, o.users_carted, o.users_purchased) == (8_487, 3_563, 2_174)
    ce = cat.clean()
    carted = ce.where("event_type = 'cart'").select("user_id").distinct()
    buyers = ce.where("event_type = 'purchase'").select("user_id").distinct()
    assert buyers.join(carted, "user_id", "left_anti").count() == 97
    p = product_metrics(ce)
    assert p.count() == 2_198 and p.where("purchasers = 0").count() == 1_294


def test_rfm_segments_present(cat):
    segs = {r.segment for r in rfm(cat.clean()).select("segment").distinct().collect()}
    assert segs == {"Champions", "Loyal", "High Value New", "Promising", "At Risk", "Hibernating", "Lost"}
