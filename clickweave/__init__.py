"""clickweave: behavioural-event (view / cart / purchase) analytics on Spark DataFrames.

Layers
------
sources/    typed ingest, the driver-table fixture, the month-partitioned event table
functions/  column builders (time, category, brand, price bucket), rounding, exact n-tile
operators/  clean, profile, funnel, cohort, rfm, product, overview, checks, sketches
plans/      the named-view catalog that persists the clean table once, and the query registry
streaming/  de-duplication and KPIs on Structured Streaming
"""

__version__ = "0.1.0"
