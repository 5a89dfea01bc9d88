"""Vector distance as a native higher-order expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance in double precision; null when widths differ."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    sq = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    total = F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total))
