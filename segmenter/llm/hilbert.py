"""Sharding by Hilbert-curve order (DataFrame operations only).

Several metadata columns are quantised to a few bits each, combined into the
index of the Hilbert curve through that grid, and the rows are cut into runs of
equal row counts along the curve. Rows of a shard then lie close in every
dimension at once, so the minimum and maximum of any of the columns prune
shards and files.

The curve index walks a state table from the highest bit to the lowest: the
bits of all dimensions at one level select the cell, the state gives the cell's
place along the curve and the next state. The table is made from the curve's
Gray-code rule for the wanted number of dimensions; Spark looks it up as an
array literal.

Quantising: a text or category column takes the order of its frequency rank
(the 2**bits - 1 most frequent values have cells of their own, all others
share the last one); a number takes its place among the column's quantiles.
Both tables have at most 2**bits entries, so they may be collected.

Order inside a cell: ``text_crc32``, then ``doc_id``, then a hash of the row,
so equal texts with equal metadata stand together. The law is ``rows``: run
lengths differ by one at most. Cutting at fixed counts may split a group of
equal texts between two neighbouring shards; the law leaves no other way.

Defined results: a null text has no bytes (size 16, crc32 of nothing: 0); null
dimensions take a cell of their own (0); repeated rows each get a slot; a null
``doc_id`` is placed as any row; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import rank_table


def curve_table(dims: int) -> list[int]:
    """State table of the Hilbert curve in ``dims`` dimensions: entry
    ``state * 2**dims + cell`` is ``next_state * 2**dims + place``.

    A state is the (entry corner, direction) of the sub-cube; cells are visited
    in Gray-code order after turning the sub-cube back by its state.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def rotate(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & mask if k else x

    gray = [w ^ (w >> 1) for w in range(size)]
    place = {g: w for w, g in enumerate(gray)}

    def entry(w: int) -> int:
        return 0 if w == 0 else gray[2 * ((w - 1) // 2)]

    def ones(w: int) -> int:
        n = 0
        while w & 1:
            n, w = n + 1, w >> 1
        return n

    def turn(w: int) -> int:
        if w == 0:
            return 0
        return ones(w - 1 if w % 2 == 0 else w) % dims

    states, table, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        e, d = todo.pop()
        for cell in range(size):
            w = place[rotate(cell ^ e, -(d + 1))]
            nxt = (e ^ rotate(entry(w), d + 1), (d + turn(w) + 1) % dims)
            if nxt not in states:
                states[nxt] = len(states)
                todo.append(nxt)
            table[(states[(e, d)], cell)] = states[nxt] * size + w
    return [table[(s, c)] for s in range(len(states)) for c in range(size)]


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Curve index of integer ``cells``, each in 0 .. 2**bits - 1."""
    dims = len(cells)
    if dims < 2 or dims * bits > 62:
        raise ValueError("the curve needs two dimensions at least and 62 bits at most")
    size = 1 << dims
    table = F.array(*[F.lit(x) for x in curve_table(dims)])
    grid = F.array(*[c.cast("long") for c in cells])

    def step(acc: Column, level: Column) -> Column:
        cell = F.aggregate(grid, F.lit(0).cast("long"), lambda c, x: c * 2 + F.expr("0L") + F.call_function(
            "getbit", x, level))
        found = F.element_at(table, (acc["state"] * size + cell + 1).cast("int"))
        return F.struct((found / size).cast("int").cast("long").alias("state"),
                        (acc["index"] * size + found % size).cast("long").alias("index"))

    start = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda a: a["index"])


def category_cell(df: DataFrame, column: str, bits: int) -> Column:
    """1.. for the most frequent values, the last cell for the rest, 0 for null."""
    top = (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), column).limit((1 << bits) - 2).collect())
    if not top:
        return F.when(F.col(column).isNull(), 0).otherwise((1 << bits) - 1)
    # Neighbouring cells hold neighbouring values.
    cells = F.create_map(*[x for i, v in enumerate(sorted(r[column] for r in top)) for x in (F.lit(v), F.lit(i + 1))])
    return F.when(F.col(column).isNull(), 0).otherwise(F.coalesce(F.try_element_at(cells, F.col(column)), F.lit((1 << bits) - 1)))


def number_cell(df: DataFrame, column: str, bits: int) -> Column:
    """Place among 2**bits - 1 quantiles, from 1; 0 for null."""
    n = (1 << bits) - 1
    edges = df.select(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000).alias("q")).head()["q"]
    cuts = sorted(set(edges or []))
    if not cuts:
        return F.when(F.col(column).isNull(), 0).otherwise(1)
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(column)))
    return F.when(F.col(column).isNull(), 0).otherwise(place + 1)


def hilbert_shards(rows: DataFrame, categories: list[str], numbers: list[str], order: list[str],
                   shards: int = 40, bits: int = 5) -> DataFrame:
    """``rows`` with ``curve`` (Hilbert index), ``shard`` and ``slot``.

    ``order``: tie-break columns inside a cell.
    """
    cells = [category_cell(rows, c, bits) for c in categories] + [number_cell(rows, c, bits) for c in numbers]
    placed = rows.withColumn("curve", hilbert_index(cells, bits))
    ranked = rank_table(placed, ["curve", *order], rank_col="_rank")
    total = ranked.sizes.get(0, 0)
    r = F.col("_rank") - 1
    # Shards 0 .. rest - 1 hold one row more than the others.
    small, rest = divmod(total, shards)
    edge = rest * (small + 1)
    long_part = F.expr(f"cast((_rank - 1) div {small + 1} as int)")
    short_part = F.expr(f"cast({rest} + (_rank - 1 - {edge}) div {max(small, 1)} as int)")
    shard = F.when(r < edge, long_part).otherwise(short_part)
    slot = F.when(r < edge, r % (small + 1)).otherwise((r - edge) % max(small, 1))
    return ranked.df.withColumn("shard", shard).withColumn("slot", slot.cast("long")).drop("_rank")


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every
    document, along the curve through language, source and text size."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    placed = hilbert_shards(rows, ["lang", "source"], ["size"], ["text_crc32", "doc_id", "size"], shards, bits)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")
