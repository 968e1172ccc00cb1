"""Exact percentiles without sorting: the rank's value by narrowing histograms.

Values come counted (one row per distinct value). Each round cuts the range in which a rank still may
lie into ``BINS`` bins of equal width, counts them with a partial aggregate, and goes on with the
smallest and largest value of the bin that the rank falls into, until they are one. Bins depend on
the value alone and keep its order, so the answer is exact; the least and the greatest value of a range
fall into different bins, so every round narrows it. The driver reads at most BINS rows per percentile
and round, whatever the number of values, and no task holds more than its partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

BINS = 1024


def percentiles_disc(counted: DataFrame, probs: Sequence[float], value: str = "value", n: str = "n") -> list[float | None]:
    """``PERCENTILE_DISC(p)`` for each p over the finite values of ``counted`` (value, n), each weighing its
    n: the smallest value whose rows and those below it are at least p of all. NULL without values."""
    v = F.col(value)
    finite = counted.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(v.cast("double").alias("v"), F.col(n).alias("n"))
    total, lo, hi = finite.agg(F.sum("n"), F.min("v"), F.max("v")).first()
    if not total:
        return [None] * len(probs)
    ranks = [max(1, math.ceil(total * p)) for p in probs]
    where = [(lo, hi, 0)] * len(probs)  # from, to, rows below
    while open_ := [i for i, (a, b, _) in enumerate(where) if a < b]:
        place = []
        for i in open_:
            a, b, _ = where[i]
            share = (F.col("v") - a) / (b - a) if math.isfinite(b - a) else (F.col("v") / 2 - a / 2) / (b / 2 - a / 2)
            bin_ = F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")
            place.append(F.when(F.col("v").between(a, b), F.struct(F.lit(i).alias("i"), bin_.alias("bin"))))
        bins = (finite.select("v", "n", F.explode(F.array_compact(F.array(*place))).alias("x"))
                .groupBy("x.i", "x.bin").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        rows = sorted(bins.collect(), key=lambda r: r.bin)
        for i in open_:
            below = where[i][2]
            for r in (r for r in rows if r.i == i):
                if below + r.n >= ranks[i]:
                    where[i] = (r.lo, r.hi, below)
                    break
                below += r.n
    return [a for a, _, _ in where]
