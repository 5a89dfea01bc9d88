"""Column -> Column functions (all built from Spark's own expressions)."""

from .dates import parse_date, period_key, recency_days, week_of_year_sunday
from .ids import normalize_id
from .numbers import text_to_number
from .text import boldify, extract_after, wrap_fixed
from .vectors import l2_distance

__all__ = [
    "boldify", "extract_after", "l2_distance", "normalize_id", "parse_date", "period_key",
    "recency_days", "text_to_number", "week_of_year_sunday", "wrap_fixed",
]
