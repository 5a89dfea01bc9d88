"""Exact order statistics by selection (C5, Q1-Q3, Q7, A3, A4): no sort, no
shuffle of values, no written copy.

To find the value at rank r of a column, a pass over the data takes a mergeable
quantile sketch (KLL) of it. The sketch gives two items of the data around the
value. Such ends cut the column into cells: under, at, between and above them.
The next pass counts every cell exactly and sketches it. The counts tell the
cell of r whatever the sketch's error: the value is one of the ends, or in a
cell that is some hundred times smaller, and that goes on with its own sketch.
When no more than ``SMALL`` rows are left, they are fetched and the value is
read off. All columns and ranks share the passes, which are plain aggregations
by cell: what a task sends is one count and one sketch of a fixed size a cell,
and beyond ``FAN`` tasks these are merged in two steps. The number of passes
grows with the logarithm of the rows to a base of about 100.

Ranks inside ties (the first-come order of Q3) go by a text column: among the
rows of the tied value, five bytes of the text at a time are a number that keeps
the texts' order, and numbers are selected as above.

Values are doubles; null is not counted, NaN sorts last.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions_for

SMALL = 2048      # rows of a cell that are fetched
GRID = 512        # steps at which a sketch is read
SKETCH_K = 2000   # KLL size: a rank error of about 1/1000
FAN = 256         # tasks whose sketches one task merges
CHUNK = 5         # bytes of a tie text per number


@dataclass(frozen=True)
class _Rows:
    """The rows of a column, or those of them with the value ``tied`` whose tie
    texts begin with ``chunks``. Their key is the value, or the next chunk."""
    name: str
    tied: float | None = None
    chunks: tuple[int, ...] = ()


@dataclass
class _Cell:
    n: int
    nan: int
    grid: list[float] | None
    least: float | None = None
    greatest: float | None = None


@dataclass
class _Want:
    """A rank under way, from 1 within ``rows``. The key lies strictly between
    ``lo`` and ``hi`` (None: open), as do ``inside`` rows; ``base`` lie before."""
    origin: int
    rank: int
    rows: _Rows
    inside: int
    grid: list[float] | None = None
    lo: float | None = None
    hi: float | None = None
    base: int = 0


def _name(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def _number(x: float) -> str:
    return f"{float(x)!r}D" if math.isfinite(x) else f"double('{float(x)!r}')"


def _chunk_of(text: bytes, i: int) -> int:
    part = text[CHUNK * i:CHUNK * (i + 1)]
    return int.from_bytes(part.ljust(CHUNK, b"\0"), "big") * 8 + len(part)


def _bytes_of(chunk: float) -> bytes:
    c = int(chunk)
    return (c >> 3).to_bytes(CHUNK, "big")[:c & 7]


def _cell_of(ends: list[float], first: int = 0) -> str:
    """SQL for the cell of ``key``, by binary search."""
    if not ends:
        return str(2 * first)
    m = len(ends) // 2
    return (f"if(key < {_number(ends[m])}, {_cell_of(ends[:m], first)}, "
            f"if(key = {_number(ends[m])}, {2 * (first + m) + 1}, {_cell_of(ends[m + 1:], first + m + 1)}))")


def _inside(w: _Want, v: float, tie: str | None) -> bool:
    """Whether a fetched row is one of those left of a want."""
    key, low, high = v, -math.inf if w.lo is None else w.lo, math.inf if w.hi is None else w.hi
    if w.rows.tied is not None:
        if v != w.rows.tied and not (math.isnan(v) and math.isnan(w.rows.tied)):
            return False
        text = tie.encode()
        if any(_chunk_of(text, i) != c for i, c in enumerate(w.rows.chunks)):
            return False
        key = _chunk_of(text, len(w.rows.chunks))
    # NaN is above all ends.
    return (w.lo is None or key > low or math.isnan(key)) and (w.hi is None or key < high)


class Selection:
    """Order statistics of columns of ``df``: ``columns`` is {name: (value
    column, tie column or None)}. ``df`` is read once per pass, so it should be
    a stored table or cheap to compute."""

    def __init__(self, df: DataFrame, columns: dict[str, tuple[str, str | None]], small: int = SMALL):
        self.columns, self.small = columns, small
        used = {c for pair in columns.values() for c in pair if c}
        self.df = df.select(*[F.col(_name(c)) for c in sorted(used)])
        self.two_steps = partitions_for(self.df) > FAN
        self.passes = 0
        self.value = {n: f"cast({_name(v)} as double)" for n, (v, _) in columns.items()}
        whole = self._pass({_Rows(n): [] for n in columns})
        self.first = {r.name: cells[0] for r, cells in whole.items()}
        self.n = {n: c.n for n, c in self.first.items()}

    # Expressions are SQL text: some dozen ends make long ones, which Spark takes in one call.

    def _part(self, name: str, start: int, length: int) -> str:
        """Bytes of the tie, from 0."""
        return f"substring(encode(coalesce(cast({_name(self.columns[name][1])} as string), ''), 'UTF-8'), {start + 1}, {length})"

    def _chunk(self, name: str, i: int) -> str:
        """Bytes 5i .. 5i+4 of the tie as a number in the order of the texts: the
        bytes, filled up with zeros, then how many there are (:func:`_chunk_of`)."""
        part = self._part(name, CHUNK * i, CHUNK)
        return f"(cast(conv(rpad(hex({part}), {2 * CHUNK}, '0'), 16, 10) as double) * 8 + length({part}))"

    def _rows(self, rows: _Rows) -> tuple[str, str]:
        """(condition, key) of the rows."""
        v = self.value[rows.name]
        if rows.tied is None:
            return f"{v} is not null", v
        begin = b"".join(map(_bytes_of, rows.chunks))  # whole chunks: a text goes on after them
        cond = f"{v} = {_number(rows.tied)}"
        if begin:
            cond += f" and {self._part(rows.name, 0, len(begin))} = X'{begin.hex()}'"
        return cond, self._chunk(rows.name, len(rows.chunks))

    def _between(self, w: _Want) -> str:
        """Condition for the rows left of a want; the bytes of ties are in the order of their numbers."""
        cond, key = self._rows(w.rows)
        literal = _number
        if w.rows.tied is not None:
            key = self._part(w.rows.name, CHUNK * len(w.rows.chunks), CHUNK)

            def literal(x):
                return f"X'{_bytes_of(x).hex()}'"
        return " and ".join([cond] + [f"{key} {op} {literal(x)}" for op, x in ((">", w.lo), ("<", w.hi)) if x is not None])

    def _pass(self, ends: dict[_Rows, list[float]]) -> dict[_Rows, list[_Cell]]:
        """Count and sketch of every cell, in one aggregation. Cell 2i lies
        before end i, cell 2i + 1 at it."""
        self.passes += 1
        parts, places = [], []
        for u, (rows, at) in enumerate(ends.items()):
            cond, key = self._rows(rows)
            parts.append(f"if({cond}, struct({u} as u, {key} as key), null)")
            places.append(f"when {u} then {_cell_of(at)}")
        # Keys first: they are long expressions, and every row has one place among the ends.
        keyed = self.df.selectExpr(f"inline(array_compact(array({', '.join(parts)})))")
        cells = keyed.selectExpr("u", f"case u {' '.join(places)} end as cell", "key")
        key = F.col("key")
        sums = [F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(key)).alias("nan"), F.kll_sketch_agg_double(key, F.lit(SKETCH_K)).alias("sketch"),
                F.min(key).alias("least"), F.max(key).alias("greatest")]
        if self.two_steps:
            some = cells.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN))).groupBy("u", "cell", "part").agg(*sums)
            found = some.groupBy("u", "cell").agg(F.sum("n").alias("n"), F.sum("nan").alias("nan"),
                                                  F.kll_merge_agg_double(F.col("sketch"), F.lit(SKETCH_K)).alias("sketch"),
                                                  F.min("least").alias("least"), F.max("greatest").alias("greatest"))
        else:
            found = cells.groupBy("u", "cell").agg(*sums)
        grid = f"if(n > nan, kll_sketch_get_quantile_double(sketch, array({', '.join(f'{i / GRID}D' for i in range(GRID + 1))})), null) as grid"
        out = {rows: [_Cell(0, 0, None) for _ in range(2 * len(at) + 1)] for rows, at in ends.items()}
        order = list(ends)
        for r in found.selectExpr("u", "cell", "n", "nan", grid, "least", "greatest").collect():
            out[order[r["u"]]][r["cell"]] = _Cell(r["n"], r["nan"], r["grid"], r["least"], r["greatest"])
        return out

    def _fetch(self, wants: list[_Want]) -> list[tuple[float, str | None]]:
        """The (value, tie) of wants that have few rows left."""
        self.passes += 1
        texts = []
        for w in wants:
            texts.append(self._between(w))
        rows = self.df.where(" or ".join(f"({t})" for t in dict.fromkeys(texts))).collect()
        answers: dict[tuple, list] = {}
        for w in wants:
            place = (w.rows, w.lo, w.hi)
            if place not in answers:
                value, tie = self.columns[w.rows.name]
                pairs = [(float(r[value]), None if tie is None else str(r[tie] or "")) for r in rows if r[value] is not None]
                mine = [(v, t) for v, t in pairs if _inside(w, v, t)]
                answers[place] = sorted(mine, key=lambda x: (math.isnan(x[0]), 0.0 if math.isnan(x[0]) else x[0], (x[1] or "").encode()))
        return [answers[w.rows, w.lo, w.hi][w.rank - w.base - 1] for w in wants]

    def _settled(self, w: _Want, key: float, n: int, before: int) -> tuple[_Want | None, tuple | None]:
        """The key is known, ``n`` rows have it and ``before`` of ``w.rows`` come
        before them: (the want for the next level of ties, the answer)."""
        rows, tie = w.rows, self.columns[w.rows.name][1]
        if rows.tied is None:
            if not tie:
                return None, (key, None)
            return _Want(w.origin, w.rank - before, _Rows(rows.name, key), n), None
        chunks = (*rows.chunks, int(key))
        if int(key) % 8 < CHUNK:  # the text ends here
            return None, (rows.tied, b"".join(map(_bytes_of, chunks)).decode())
        return _Want(w.origin, w.rank - before, _Rows(rows.name, rows.tied, chunks), n), None

    def _place(self, w: _Want, ends: list[float], cells: list[_Cell]) -> tuple[_Want | None, tuple | None]:
        """The cell of a want's rank: (what is left of the want, the answer)."""
        before = 0
        for i, c in enumerate(cells):
            if w.rank <= before + c.n:
                break
            before += c.n
        if i % 2:
            return self._settled(w, ends[i // 2], c.n, before)
        if w.rank > before + c.n - c.nan:
            return self._settled(w, math.nan, c.nan, before + c.n - c.nan)
        if c.least is not None and c.least == c.greatest:  # one key
            return self._settled(w, c.least, c.n, before)
        return replace(w, lo=ends[i // 2 - 1] if i else None, hi=ends[i // 2] if i // 2 < len(ends) else None,
                       base=before, inside=c.n, grid=c.grid), None

    def at(self, ranks: dict[str, Sequence[int]]) -> dict[str, dict[int, tuple[float, str | None]]]:
        """{name: {rank: (value, tie)}} for 1-based ``ranks``."""
        out: dict[str, dict[int, tuple]] = {name: {} for name in ranks}
        todo: list[_Want] = []

        def take(w: _Want, step: tuple[_Want | None, tuple | None]) -> None:
            if step[1]:
                out[w.rows.name][w.origin] = step[1]
            if step[0] is not None:
                todo.append(step[0])

        for name, wanted in ranks.items():
            for r in sorted(set(wanted)):
                if not 1 <= r <= self.n[name]:
                    raise ValueError(f"{name} has {self.n[name]} values, there is no rank {r}")
                w = _Want(r, r, _Rows(name), self.n[name])
                take(w, self._place(w, [], [self.first[name]]))
        while todo:
            few = [w for w in todo if w.inside <= self.small]
            for w, answer in zip(few, self._fetch(few) if few else [], strict=True):
                out[w.rows.name][w.origin] = answer
            many = [w for w in todo if w.inside > self.small]
            ends: dict[_Rows, list[float]] = {}
            for w in many:
                ends.setdefault(w.rows, [])
                if w.grid:  # the sketch's items some steps around the rank
                    at = (w.rank - w.base) / w.inside * GRID
                    ends[w.rows] += [w.grid[max(0, math.floor(at) - 2)], w.grid[min(GRID, math.ceil(at) + 2)]]
            ends = {rows: sorted(set(at)) for rows, at in ends.items()}
            cells = self._pass(ends) if many else {}
            todo.clear()
            for w in many:
                take(w, self._place(w, ends[w.rows], cells[w.rows]))
        return out

    def distinct(self, limit: int = 5) -> dict[str, int]:
        """min(limit, number of different values) of every column, from the
        sketch's items; a column with fewer of them is asked for other values."""
        seen = {n: list(dict.fromkeys(c.grid or [])) + [math.nan] * bool(c.nan) for n, c in self.first.items()}
        ask = [n for n, s in seen.items() if len(s) < limit and self.n[n]]

        def other(n: str) -> str:
            known = "".join(f" and {self.value[n]} <> {_number(x)}" for x in seen[n] if not math.isnan(x))
            return f"if(not isnan({self.value[n]}){known}, {self.value[n]}, null)"

        while ask:
            r = self.df.selectExpr(*[x for i, n in enumerate(ask) for x in (f"min({other(n)}) as lo{i}", f"max({other(n)}) as hi{i}")]).first()
            self.passes += 1
            again = []
            for i, n in enumerate(ask):
                if r[f"lo{i}"] is not None:
                    seen[n] += list(dict.fromkeys([r[f"lo{i}"], r[f"hi{i}"]]))
                    if len(seen[n]) < limit:
                        again.append(n)
            ask = again
        return {n: min(limit, len(s)) for n, s in seen.items()}


def quantile_positions(n: int, probs: Sequence[float]) -> list[tuple[int, int, float]]:
    """(lower rank, upper rank, fraction) per probability, ranks 1-based."""
    out = []
    for p in probs:
        h = (n - 1) * p
        lo = math.floor(h)
        out.append((lo + 1, math.ceil(h) + 1, h - lo))
    return out


def interpolate(found: dict[int, float], n: int, probs: Sequence[float]) -> list[float]:
    edges = []
    for lo, hi, frac in quantile_positions(n, probs):
        a, b = found[lo], found[hi]
        edges.append(a if lo == hi else a + frac * (b - a))
    return edges


def quantiles(selection: Selection, probs: dict[str, Sequence[float]]) -> dict[str, list[float] | None]:
    """Linear-interpolation quantiles (as DuckDB ``quantile_cont``) of the named
    columns; None for a column without values."""
    ranks = {c: [r for lo, hi, _ in quantile_positions(selection.n[c], p) for r in (lo, hi)] for c, p in probs.items() if selection.n[c]}
    found = selection.at(ranks)
    return {c: interpolate({r: v for r, (v, _) in found[c].items()}, selection.n[c], p) if c in found else None for c, p in probs.items()}


def exact_quantiles_many(df: DataFrame, probs: dict[str, Sequence[float]]) -> dict[str, list[float] | None]:
    """:func:`quantiles` of several columns' non-null values, in shared passes."""
    return quantiles(Selection(df, {c: (c, None) for c in probs}), probs)


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float] | None:
    return exact_quantiles_many(df, {column: probs})[column]


def exact_median(df: DataFrame, column: str) -> float | None:
    q = exact_quantiles(df, column, [0.5])
    return None if q is None else q[0]
