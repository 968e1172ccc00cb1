"""SQL access and serving output for the named relations.

``register_views`` exposes the relations as temporary views under the source model's
names so analysts can keep writing SQL against them; ``export_views`` writes each one as
parquet for a BI import (the source model's dashboard reads its views once at import).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from clickweave.operators.cohort import cohort_retention
from clickweave.operators.funnel import funnel
from clickweave.operators.overview import overview
from clickweave.plans.catalog import EventCatalog

VIEWS: dict[str, Callable[[EventCatalog], DataFrame]] = {
    "vw_clean_events": lambda c: c.clean(),
    "vw_funnel": lambda c: funnel(c.clean(), c.params.events),
    "vw_cohort": lambda c: cohort_retention(c.clean(), c.params.events, c.params.weeks),
    "vw_rfm": lambda c: c.rfm(),
    "vw_product": lambda c: c.product(),
    "vw_overview": lambda c: overview(c.clean(), c.params.events),
}

# Presentation order of each view, applied only when writing serving output.
SINK_ORDER = {
    "vw_funnel": ["row_type", "event_month", "category_top"],
    "vw_cohort": ["cohort_week"],
    "vw_rfm": ["avg_rfm_score"],
    "vw_product": ["event_month", "revenue"],
    "vw_overview": ["event_month"],
}
_DESC = {("vw_rfm", "avg_rfm_score"), ("vw_product", "revenue")}


def register_views(catalog: EventCatalog, names: Iterable[str] | None = None) -> list[str]:
    """Create or replace temporary views; returns their names."""
    done = []
    for name in names or VIEWS:
        VIEWS[name](catalog).createOrReplaceTempView(name)
        done.append(name)
    return done


def export_views(catalog: EventCatalog, out_root: str, names: Iterable[str] | None = None) -> dict[str, str]:
    """Write each view as parquet under ``out_root/<name>``; small views are sorted for
    presentation, the clean table keeps its month partitioning."""
    from pyspark.sql import functions as F

    paths = {}
    for name in names or VIEWS:
        df = VIEWS[name](catalog)
        path = f"{out_root.rstrip('/')}/{name}"
        if name == "vw_clean_events":
            df.write.mode("overwrite").partitionBy("event_month").parquet(path)
        else:
            order = [F.col(c).desc() if (name, c) in _DESC else F.col(c).asc() for c in SINK_ORDER.get(name, [])]
            (df.orderBy(*order) if order else df).write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths
