import datetime as dt

from clickweave.schema import EVENT_SCHEMA


def events(spark, rows):
    """Rows as dicts over the canonical schema (missing keys are NULL)."""
    names = [f.name for f in EVENT_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVENT_SCHEMA)


def ev(t, et, user="u1", product="p1", price=10.0, session="s1", code="electronics.phone", brand="Acme",
       category_id="c1"):
    if isinstance(t, str):
        t = dt.datetime.fromisoformat(t)
    return dict(event_time=t, event_type=et, user_id=user, product_id=product, price=price,
                user_session=session, category_code=code, brand=brand, category_id=category_id)
