"""Column builders shared by the operators."""

from clickweave.functions.numeric import money, pct, round_n, safe_ratio
from clickweave.functions.dims import (
    brand_norm, category_depth, category_top, price_bucket, price_bucket_labels, time_dims,
)
from clickweave.functions.ntile import exact_ntile, exact_ntiles

__all__ = [
    "money", "pct", "round_n", "safe_ratio",
    "brand_norm", "category_depth", "category_top", "price_bucket", "price_bucket_labels", "time_dims",
    "exact_ntile", "exact_ntiles",
]
