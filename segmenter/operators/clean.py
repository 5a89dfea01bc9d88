"""Cleaning, median imputation, clamping and data-quality counters.

One conditional aggregation for all null counts and, only for columns that have
nulls, an exact median by selection; then a single projection that fills and clamps. The medians are computed before
clamping, on all non-null values, negative ones included.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date, recency_days
from ..functions.ids import normalize_id
from ..functions.numbers import text_to_number
from ..session import cut_lineage, cut_lineage_observed
from .selection import exact_quantiles_many

MEASURES = ["recency", "amount", "frequency"]


@dataclass
class CleanResult:
    df: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    medians: dict[str, float | None] = field(default_factory=dict)

    def report(self, spark) -> DataFrame:
        rows = [(k.split(":")[0], k.split(":")[1], int(v)) for k, v in self.counts.items()]
        return spark.createDataFrame(rows, "rule STRING, column STRING, n BIGINT")


def _numeric(c: Column, dtype: str) -> Column:
    if dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") or dtype.startswith("decimal"):
        v = c.cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return text_to_number(c)


def typed_frame(df: DataFrame, as_of: dt.date | str | None = None, phone_only: bool = False,
                passthrough: tuple[str, ...] = ()) -> DataFrame:
    """Normalise ids, parse dates and numbers; adds ``_date_raw_present`` for counting.

    Rows are not dropped here; see :func:`clean_customers`.
    """
    types = dict(df.dtypes)
    cols = [F.col(c) for c in passthrough]
    cols.append(normalize_id(F.col("client_id"), phone_only).alias("client_id"))
    if "date" in types and "recency" not in types:
        if as_of is None:
            raise ValueError("as_of is required to derive recency from dates")
        d = F.col("date") if types["date"].startswith("timestamp") or types["date"] == "date" \
            else parse_date(F.col("date"))
        cols.append(d.cast("timestamp_ntz").alias("date"))
        cols.append(recency_days(d, as_of).alias("recency"))
    elif "recency" in types:
        cols.append(_numeric(F.col("recency"), types["recency"]).alias("recency"))
    for m in ("amount", "frequency"):
        if m in types:
            cols.append(_numeric(F.col(m), types[m]).alias(m))
    return df.select(*cols)


def clean_customers(df: DataFrame, as_of: dt.date | str | None = None,
                    phone_only: bool = False, passthrough: tuple[str, ...] = ()) -> CleanResult:
    """Canonical frame in, clean frame out: ids non-null, measures filled and >= 0."""
    # Materialise the typed input once, counting nulls and negatives while it
    # is written: the medians and the cleaning projection then read the table
    # instead of recomputing its lineage.
    typed0 = typed_frame(df, as_of, phone_only, passthrough)
    has_date = "date" in typed0.columns
    measures = [m for m in MEASURES if m in typed0.columns]
    id_ok = F.col("client_id").isNotNull()
    date_ok = F.col("date").isNotNull() if has_date else F.lit(True)
    kept = id_ok & date_ok
    aggs = [F.count(F.lit(1)).alias("rows"),
            F.count_if(~id_ok).alias("null_ids"),
            F.count_if(id_ok & ~date_ok).alias("bad_dates")]
    aggs += [F.count_if(kept & F.col(m).isNull()).alias(f"null_{m}") for m in measures]
    aggs += [F.count_if(kept & (F.col(m) < 0)).alias(f"neg_{m}") for m in measures]
    typed, stats = cut_lineage_observed(typed0, "typed", *aggs)

    base = typed.where(kept)
    gaps = [m for m in measures if stats[f"null_{m}"] > 0]
    medians: dict[str, float | None] = {}
    if gaps:
        medians = {m: (q[0] if q else None)
                   for m, q in exact_quantiles_many(base, {m: [0.5] for m in gaps}).items()}

    out_cols = [F.col(c) for c in passthrough] + [F.col("client_id")]
    if has_date:
        out_cols.append(F.col("date"))
    counts = {"rejected:null_id": stats["null_ids"]}
    if has_date:
        counts["rejected:bad_date"] = stats["bad_dates"]
    drop_all = False
    for m in measures:
        filled = F.col(m)
        n_null = stats[f"null_{m}"]
        med = medians.get(m)
        if n_null > 0 and med is not None:
            filled = F.coalesce(F.col(m), F.lit(float(med)))
        counts[f"filled:{m}"] = n_null if med is not None else 0
        counts[f"clamped:{m}"] = stats[f"neg_{m}"] + (n_null if (med is not None and med < 0) else 0)
        if n_null > 0 and med is None:
            drop_all = True
        counts[f"dropped:{m}"] = 0
        out_cols.append(clamp(filled).alias(m))
    clean = base.select(*out_cols)
    if drop_all:
        # Every value of some measure was missing: the reference drops every row
        # at the first such measure.
        first = next(m for m in measures if stats[f"null_{m}"] > 0 and medians.get(m) is None)
        counts[f"dropped:{first}"] = stats["rows"] - stats["null_ids"] - stats["bad_dates"]
        clean = clean.where(F.lit(False))
    return CleanResult(clean, counts, medians)


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """C5 alone: null -> exact median of the column's non-null values, all
    columns in the same passes over the rows, which are written once for them
    (no fill when a column is all null)."""
    df = cut_lineage(df, "gaps")
    meds = exact_quantiles_many(df, {c: [0.5] for c in columns})
    return df.select(*[F.coalesce(F.col(c), F.lit(float(meds[c][0]))).alias(c)
                       if (c in meds and meds[c] is not None) else F.col(c) for c in df.columns])


def clamp(c: Column) -> Column:
    """C6 on one column: value < 0 -> 0; null stays null."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def clamp_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value < 0 -> 0 in ``columns``."""
    return df.select(*[clamp(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
