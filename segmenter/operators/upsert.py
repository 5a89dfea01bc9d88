"""Keyed writes on plain Parquet tables.

Parquet has no MERGE, so an upsert is last-write-wins: union the current rows
and the changes, keep the newest version per key with ``max_by`` (a partial
aggregation -- a key updated millions of times never gathers its versions in
one buffer), and write the result as a new table version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_seen(msgs: DataFrame, user_col: str = "user_id", ts_col: str = "timestamp") -> DataFrame:
    """Newest message time per user."""
    return msgs.groupBy(user_col).agg(F.max(ts_col).alias("last_time"))


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str = "_version",
           columns: Sequence[str] | None = None, defaults: dict | None = None) -> DataFrame:
    """K1 / K3: insert new keys, overwrite ``columns`` of existing keys with the
    newest change (all non-key columns by default). ``changes`` carries a
    ``version`` column ordering changes of the same key; the current rows rank
    below every change. Columns not overwritten keep their current value."""
    cols = [c for c in current.columns if c != key]
    columns = list(columns) if columns is not None else cols
    cur = current.select(key, *[F.col(c) for c in cols], F.lit(-1).cast("long").alias(version),
                         F.lit(True).alias("_is_current"))
    chg = changes.select(key, *[F.col(c) if c in columns else F.lit(None).cast(dict(current.dtypes)[c]).alias(c)
                                for c in cols], F.col(version).cast("long"), F.lit(False).alias("_is_current"))
    both = cur.unionByName(chg)
    newest = F.struct(F.col(version), *[F.col(c) for c in cols])
    agg = both.groupBy(key).agg(
        F.max_by(newest, F.col(version)).alias("_new"),
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.when(F.col("_is_current"), 1)).alias("_cur"))
    out = [F.col(key)]
    for c in cols:
        if c in columns:
            out.append(F.col(f"_new.{c}").alias(c))
        else:
            out.append(F.coalesce(F.col(f"_cur.{c}"), F.col(f"_new.{c}")).alias(c))
    res = agg.select(*out)
    for c, v in (defaults or {}).items():
        res = res.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return res.select(current.columns)


def delete_keys(table: DataFrame, deletes: DataFrame, key: str, delete_key: str | None = None) -> DataFrame:
    """K4: drop every row whose key is in ``deletes`` (left anti join)."""
    d = deletes.select(F.col(delete_key or key).alias("_del")).distinct()
    return table.join(d, F.col(key) == F.col("_del"), "left_anti")
