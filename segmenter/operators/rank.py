"""Distributed ranking, global and within groups.

A window ``row_number() OVER (ORDER BY ...)`` without ``PARTITION BY`` moves the
whole table into one task. Here the table is range-partitioned on the key and
tie-break (Spark samples the key to pick boundaries, so one heavy value spread
over many tie-break values still splits over partitions), sorted inside each
partition, and numbered with ``monotonically_increasing_id``, whose low 33 bits
are the row index inside the partition. Rank = rows in earlier partitions +
index + 1.

Rows in earlier partitions are a prefix sum over the partitions' row counts, in
two levels: sums of chunks of ``CHUNK`` partitions, prefix sums over these, and
prefix sums within each chunk. Both are windows over at most a few thousand
rows; nothing is collected. The offsets are joined back by a broadcast of one
row per partition and group.

Within groups, a plain ``row_number`` window serves every group that fits in a
task. Groups of more than ``heavy_rows`` rows, of which there are at most
rows / ``heavy_rows``, take the range-partitioned way. So the offsets have no
more rows than partitions plus heavy groups, however many groups there are. A
null group is a group like any other.

The ordered table is written as Parquet under the shared checkpoint folder so
partition ids and indices stay fixed if a task is recomputed after executor
loss.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, partitions_for
from .columns import free_names

_LOW_BITS = (1 << 33) - 1
CHUNK = 1024  # partitions per chunk of the prefix sum


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


@dataclass
class Ranked:
    """A ranked frame and, without groups, its number of rows under the key 0."""
    df: DataFrame
    sizes: dict[int, int] | None


def partition_offsets(counts: DataFrame, pid: str, group: str, n: str, offset: str) -> DataFrame:
    """``counts`` (one row per partition and group) with ``offset``: rows of the
    group in earlier partitions minus rows of earlier groups in the partition.

    Groups lie in order over the partitions, so a partition's earlier groups
    are those with the smaller first index, ``counts`` has it as ``at``."""
    chunk = F.floor(F.col(pid) / CHUNK).alias("chunk")
    before = [Window.unboundedPreceding, -1]
    chunks = counts.groupBy(group, chunk).agg(F.sum(n).alias("in_chunk"))
    chunks = chunks.withColumn("before_chunk", F.coalesce(F.sum("in_chunk").over(
        Window.partitionBy(group).orderBy("chunk").rowsBetween(*before)), F.lit(0)))
    inside = counts.withColumn("chunk", chunk).withColumn("before_here", F.coalesce(F.sum(n).over(
        Window.partitionBy(group, "chunk").orderBy(pid).rowsBetween(*before)), F.lit(0)))
    c = chunks.select(F.col(group).alias("g_"), F.col("chunk").alias("chunk_"), "before_chunk")
    both = inside.join(c, inside[group].eqNullSafe(F.col("g_")) & (F.col("chunk") == F.col("chunk_")))
    return both.select(pid, group, (F.col("before_chunk") + F.col("before_here") - F.col("at")).alias(offset))


def _ranged(df: DataFrame, keys: list[Column], group: str | None, rank_col: str, n_parts: int) -> tuple[DataFrame, DataFrame]:
    """(ranked rows, row count per partition and group) by range partitions."""
    pid, mid, opid, g, off = free_names(df, "_pid", "_mid", "_opid", "_g", "_off")
    sort = ([F.col(group)] if group else []) + keys
    ordered = cut_lineage(df.repartitionByRange(n_parts, *sort).sortWithinPartitions(*sort)
                          .withColumn(pid, F.spark_partition_id())
                          .withColumn(mid, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))), "ranked")
    gcol = F.col(group) if group else F.lit(0)
    counts = ordered.groupBy(F.col(pid).alias(opid), gcol.alias(g)).agg(F.count(F.lit(1)).alias("n"), F.min(mid).alias("at"))
    offsets = partition_offsets(counts, opid, g, "n", off)
    cond = F.col(pid) == F.col(opid)
    if group:
        cond = cond & F.col(group).eqNullSafe(F.col(g))
    # One row per partition and (heavy) group.
    ranked = (ordered.join(F.broadcast(offsets), cond)
              .withColumn(rank_col, F.col(off) + F.col(mid) + 1).drop(pid, mid, opid, g, off))
    return ranked, counts


def rank_table(df: DataFrame, order_by: Sequence[str | Column], group: str | None = None, rank_col: str = "rank",
               num_partitions: int | None = None, heavy_rows: int = 1_000_000) -> Ranked:
    """Dense 1..n position in ascending ``order_by`` (inside ``group`` if given).

    ``order_by`` should end with a unique tie-break; otherwise equal keys get
    consecutive ranks in an arbitrary but fixed order. ``df`` is read twice for
    grouped ranks: once to find the groups of more than ``heavy_rows`` rows.
    """
    n_parts = num_partitions or partitions_for(df)
    keys = _as_cols(order_by)
    if group is None:
        ranked, counts = _ranged(df, keys, None, rank_col, n_parts)
        return Ranked(ranked, {0: counts.agg(F.sum("n")).first()[0] or 0})
    g, mark = free_names(df, "_group", "_heavy")
    # At most rows / heavy_rows groups.
    heavy = cut_lineage(df.groupBy(F.col(group).alias(g)).agg(F.count(F.lit(1)).alias("n"))
                        .where(F.col("n") > heavy_rows).select(g, F.lit(True).alias(mark)), "heavy")
    light_window = F.row_number().over(Window.partitionBy(group).orderBy(*keys)).cast("long")
    if heavy.isEmpty():
        return Ranked(df.withColumn(rank_col, light_window), None)
    marked = df.join(F.broadcast(heavy), F.col(group).eqNullSafe(F.col(g)), "left")
    light = marked.where(F.col(mark).isNull()).drop(g, mark).withColumn(rank_col, light_window)
    ranked, _ = _ranged(marked.where(F.col(mark)).drop(g, mark), keys, group, rank_col, n_parts)
    return Ranked(light.unionByName(ranked), None)


def with_global_rank(df: DataFrame, order_by: Sequence[str | Column], rank_col: str = "rank",
                     num_partitions: int | None = None) -> DataFrame:
    return rank_table(df, order_by, None, rank_col, num_partitions).df
