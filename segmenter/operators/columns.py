"""Header resolution, required columns, null drops, defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataQualityError
from ..schemas import CANONICAL_ORDER, COLUMN_ALIASES


def resolve_aliases(columns: list[str], aliases: dict[str, list[str]] | None = None) -> dict[str, str]:
    """canonical name -> source column. First matching source column in file
    order wins for each canonical key; headers compared after strip + lower."""
    aliases = aliases or COLUMN_ALIASES
    found: dict[str, str] = {}
    cleaned = [(c, c.strip().lower()) for c in columns]
    for key in CANONICAL_ORDER:
        accepted = {a.lower() for a in aliases.get(key, [])}
        for src, low in cleaned:
            if low in accepted:
                found[key] = src
                break
    return found


def check_required(found: dict[str, str]) -> None:
    """Need an id, and either a date or (recency and amount); scoring also needs amount."""
    if "client_id" not in found:
        raise DataQualityError("no client id column")
    if "date" not in found and ("recency" not in found or "amount" not in found):
        raise DataQualityError("no data for recency and monetary")
    if "amount" not in found:
        raise DataQualityError("no amount column")


def project_canonical(df: DataFrame, aliases: dict[str, list[str]] | None = None,
                      strict: bool = True) -> DataFrame:
    """Rename matched columns to canonical names, keep only those, canonical order."""
    found = resolve_aliases(df.columns, aliases)
    if strict:
        check_required(found)
    return df.select(*[F.col(f"`{src}`").alias(key) for key, src in found.items()])


def with_default(df: DataFrame, column: str, value: float = 1.0) -> DataFrame:
    """Add ``column`` as a constant when absent (frequency defaults to 1)."""
    if column in df.columns:
        return df
    return df.withColumn(column, F.lit(value).cast("double"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
