"""Approximate operators against their exact counterparts."""

from pyspark.sql import functions as F

from clickweave.operators.checks import rate_violations
from clickweave.operators.funnel import funnel
from clickweave.operators.product import product_events
from clickweave.operators.profile import purchase_price_profile
from clickweave.operators.sketch import product_sketches, rollup_sketches
from clickweave.schema import EVENT_COLUMNS


def test_price_profile_sketch_close_to_exact(catalog):
    raw = catalog.raw().select(*EVENT_COLUMNS)
    approx = purchase_price_profile(raw).first()
    exact = purchase_price_profile(raw, exact=True).first()
    assert (approx.min_price, approx.max_price, approx.avg_price) == (exact.min_price, exact.max_price, exact.avg_price)
    prices = sorted(r.price for r in raw.where("event_type = 'purchase' and price is not null").collect())
    for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
        got = getattr(approx, name)
        rank = sum(1 for x in prices if x <= got) / len(prices)
        assert abs(rank - p) < 0.02, (name, got, rank)


def test_sketch_rollup_close_to_exact(catalog):
    ce = catalog.clean()
    est = rollup_sketches(product_sketches(ce), ["event_month"])
    exact = (product_events(ce).groupBy("event_month")
             .agg(F.countDistinct("user_id").alias("u"),
                  F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("b")))
    for r in est.join(exact, "event_month").collect():
        assert abs(r.est_users - r.u) <= 0.03 * r.u + 1
        assert abs(r.est_purchasers - r.b) <= 0.03 * r.b + 1


def test_rate_violations_reported_not_raised(spark, catalog):
    f = funnel(catalog.clean())
    assert rate_violations(f).count() == 0
    bad = f.withColumn("overall_cvr", F.lit(150.0))
    assert rate_violations(bad).count() == f.count()
