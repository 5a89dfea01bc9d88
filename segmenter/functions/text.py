"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def boldify(c: Column | str) -> Column:
    """``**x**`` -> ``<b>x</b>``, shortest match, across newlines."""
    return F.regexp_replace(_c(c), r"(?s)\*\*(.*?)\*\*", "<b>$1</b>")


def wrap_fixed(c: Column | str, width: int = 50) -> Column:
    """Insert a newline after every ``width`` characters when more text follows."""
    return F.regexp_replace(_c(c), rf"(?s)(.{{{width}}})(?=.)", "$1\n")


def extract_after(c: Column | str, heading: str, label: str) -> Column:
    """Integer after ``<heading>:\\n<spaces><label>: `` in a report text, else null."""
    pattern = r"\Q" + heading + r"\E:\n\s+" + re.escape(label) + r": (\d+)"
    found = F.regexp_extract(_c(c), pattern, 1)
    return F.when(found != "", found.cast("long"))
