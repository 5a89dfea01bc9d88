"""Embedding whitening with a covariance over distinct vectors and their counts.

Vectors are turned into whole numbers ``x = floor(scale * c) + offset``, so that
equal vectors are equal keys and sums are exact. Equal x-vectors are grouped
into one row with a multiplicity; with ``weights="counts"`` the multiplicity is
the fit weight, with ``weights="one"`` every distinct vector weighs the same.

Fit: one pass gives n and the exact sums S, a second the covariance as a
weighted matrix product per Arrow batch of centred vectors. Centring subtracts
the whole part of S/n in integers first and its fraction in doubles after, so
no digits are lost to the offset. What reaches the driver is d sums and d * d
products, whatever the number of rows; the eigenvectors are taken there.

Whitening: every distinct vector is projected once, and the result is joined
back to the rows by a 128-bit key of the vector. Before it is used, the keys are
checked to be different for different vectors (another seed is taken if not), so
rows carry 16 bytes instead of a vector through the join and the join is exact.
Vectors that many rows share are joined by a broadcast instead: those with at
least 1/``heavy`` of all rows, of which there are at most ``heavy``.

Defined results: rows whose vector is null, or holds a null, a non-finite entry
or one whose x leaves +-2**61, are dropped; vectors of different widths are
whitened apart, each width with its own n; an empty vector has no components and
gives no rows; a component without variance has a null ``whitened`` and does not
count in ``identity_error``; a ``deviation`` beyond 64 bits is null; a null id
keeps its row, repeated rows give repeated rows; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

LIMIT = float(1 << 61)
ROWS = 4096


@dataclass
class Fit:
    """The whitening of one width: what a task needs to project vectors."""
    n: int                   # total fit weight
    sums: list[int]          # exact sums S per dimension
    components: np.ndarray   # (k, d) unit eigenvectors, largest eigenvalue first
    eigenvalues: np.ndarray  # (k,)
    trace: float

    @property
    def floors(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rests(self) -> list[int]:
        return [s % self.n for s in self.sums]


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """(id, x) of the rows whose vector has whole-number form."""
    v = F.col(f"`{vec_col}`")
    big = F.lit(LIMIT / scale)
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < big, F.lit(False)))  # NaN is above all numbers
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))
    return (df.select(F.col(f"`{id_col}`").alias("id"), F.when(fine, x).alias("x")).where("x is not null and size(x) > 0"))


def _vectors(batch, column: str = "x") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, start of each row, width of each row) of a list column."""
    col = batch.column(column)
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False), off[:-1].astype(np.int64), np.diff(off).astype(np.int64)


def _by_width(batch, column: str = "x"):
    """Yields (width, row numbers, matrix) for every width in the batch."""
    flat, start, width = _vectors(batch, column)
    for d in np.unique(width):
        at = np.flatnonzero(width == d)
        yield int(d), at, flat[start[at][:, None] + np.arange(d)]


def _sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{width: (n, exact sums per dimension)}."""

    def add(batches):
        import pyarrow as pa

        total: dict[int, list] = {}
        for batch in batches:
            w = batch.column("w").to_numpy()
            for d, at, x in _by_width(batch):
                wd = w[at]
                exact = int(np.abs(x).max(initial=0)) * int(wd.sum()) < 1 << 62
                part = wd @ x if exact else wd.astype(object) @ x.astype(object)
                n, s = total.get(d, (0, [0] * d))
                total[d] = (n + int(wd.sum()), [a + int(b) for a, b in zip(s, part, strict=True)])
        rows = [(d, i, str(v)) for d, (n, s) in total.items() for i, v in enumerate([n, *s])]
        yield pa.RecordBatch.from_pydict({"d": pa.array([r[0] for r in rows], pa.int32()), "i": pa.array([r[1] for r in rows], pa.int32()),
                                          "v": pa.array([r[2] for r in rows], pa.string())})

    rows = (distinct.select("w", "x").mapInArrow(add, "d int, i int, v string")
            .groupBy("d", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect())
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["d"], r["i"])):
        out.setdefault(r["d"], []).append(int(r["v"]))
    return {d: (v[0], v[1:]) for d, v in out.items()}


def _centred(x: np.ndarray, floors: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    return (x - floors).astype(np.float64) - fraction


def _products(distinct: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """{width: covariance}, divisor n."""
    centre = {d: (np.array([v // n for v in s], np.int64), np.array([v % n / n for v in s])) for d, (n, s) in sums.items()}

    def multiply(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            w = batch.column("w").to_numpy()
            for d, at, x in _by_width(batch):
                c = _centred(x, *centre[d])
                part = (c * w[at, None]).T @ c
                total[d] = total[d] + part if d in total else part
        for d, m in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(len(i), d), pa.int32()), "i": pa.array(i, pa.int32()),
                                              "j": pa.array(j, pa.int32()), "v": pa.array(m[i, j])})

    out = {d: np.zeros((d, d)) for d in sums}
    for r in distinct.select("w", "x").mapInArrow(multiply, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["d"]][r["i"], r["j"]] = out[r["d"]][r["j"], r["i"]] = r["v"] / sums[r["d"]][0]
    return out


def fit(distinct: DataFrame, components: int) -> dict[int, Fit]:
    """Whitening of each width in ``distinct`` (x, w)."""
    sums = _sums(distinct)
    fits = {}
    for d, cov in _products(distinct, sums).items():
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][:components]
        # One sign for all rows: a component's largest entry is positive.
        pick = vectors[:, order].T
        pick = pick * np.sign(pick[np.arange(len(pick)), np.abs(pick).argmax(axis=1)])[:, None]
        n, s = sums[d]
        trace = float(np.trace(cov))
        live = values[order] > trace * d * np.finfo(float).eps
        fits[d] = Fit(n, s, pick, np.where(live, values[order], 0.0), trace)
    return fits


def _deviation(x: np.ndarray, f: Fit) -> list:
    """sum over dimensions of (n*x - S)**2, exact; None beyond 64 bits."""
    c, rest = x - f.floors, np.array(f.rests, np.int64)
    bound = (float(np.abs(c).max(initial=0)) + 1.0) * f.n
    if bound * bound * len(rest) < 2.0 ** 62:
        d = c * f.n - rest
        return (d * d).sum(axis=1).tolist()
    d = c.astype(object) * f.n - rest.astype(object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def _project(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(k1, k2, w, d, z, deviation): every distinct vector whitened once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                for d, at, x in _by_width(part):
                    f = fits[d]
                    c = _centred(x, f.floors, np.array(f.rests, np.float64) / f.n)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        z = (c @ f.components.T) / np.sqrt(f.eigenvalues)
                    live = f.eigenvalues > 0
                    z[:, ~live] = 0.0
                    flat = pa.array(z.ravel(), mask=np.tile(~live, len(z)))
                    yield pa.RecordBatch.from_pydict({
                        **{k: part.column(k).take(pa.array(at)) for k in ("k1", "k2", "w")},
                        "d": pa.array(np.full(len(at), d), pa.int32()),
                        "z": pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat),
                        "deviation": pa.array(_deviation(x, f), pa.int64())})

    return distinct.mapInArrow(run, "k1 long, k2 long, w long, d int, z array<double>, deviation long")


def _identity_errors(white: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """{width: largest absolute entry of the whitened covariance minus the identity}."""
    k = max(len(f.eigenvalues) for f in fits.values())
    z = [F.get("z", F.lit(i)) for i in range(k)]
    means = {r["d"]: r for r in white.groupBy("d").agg(*[(F.sum(F.col("w") * c)).alias(f"s{i}") for i, c in enumerate(z)]).collect()}
    out = {}
    for d, f in fits.items():
        live = np.flatnonzero(f.eigenvalues > 0).tolist()
        if not live:
            out[d] = None
            continue
        c = {i: z[i] - F.lit(means[d][f"s{i}"] / f.n) for i in live}
        pairs = [(i, j) for i in live for j in live if i <= j]
        got = white.where(F.col("d") == d).agg(*[F.sum(F.col("w") * c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
        out[d] = max(abs(got[f"p{i}_{j}"] / f.n - (i == j)) for i, j in pairs)
    return out


def _keys(x: str, seed: int):
    return F.xxhash64(F.lit(seed), x).alias("k1"), F.xxhash64(x, F.lit(~seed)).alias("k2")


def distinct_vectors(rows: DataFrame, weights: str) -> tuple[DataFrame, int]:
    """(k1, k2, x, rows, w) of the different x-vectors, written, and the seed of
    their keys, for which no two vectors have the same key."""
    grouped = rows.groupBy("x").agg(F.count(F.lit(1)).alias("rows"))
    w = F.col("rows") if weights == "counts" else F.lit(1).cast("long")
    table = tk.cut_lineage(grouped.select("x", "rows", w.alias("w")), "vectors")
    for seed in range(16):
        keyed = table.select(*_keys("x", seed), "x", "rows", "w")
        if not keyed.groupBy("k1", "k2").count().where("count > 1").limit(1).count():
            return keyed, seed
    raise RuntimeError("no seed gives the vectors different keys")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024,
           offset: int = 100_000, weights: str = "counts", heavy: int = 1000) -> DataFrame:
    """One row per row of ``df`` with a usable vector: ``id_col``, n, deviation,
    z (whitened components, largest first), explained, identity_error, width."""
    if weights not in ("counts", "one"):
        raise ValueError(f"weights is counts or one, not {weights!r}")
    spark = df.sparkSession
    rows = quantise(df, id_col, vec_col, scale, offset)
    distinct, seed = distinct_vectors(rows, weights)
    fits = fit(distinct, components)
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n long, deviation long, z array<double>, explained array<double>, identity_error double, width int"
    if not fits:
        return spark.createDataFrame([], schema)
    white = tk.cut_lineage(_project(distinct, fits), "whitened")
    errors = _identity_errors(white, fits)
    # One row per width.
    facts = spark.createDataFrame([(d, f.n, [float(e / f.trace) if f.trace else 0.0 for e in f.eigenvalues], errors[d])
                                   for d, f in fits.items()], "d int, n long, explained array<double>, identity_error double")
    answers = white.join(F.broadcast(facts), "d").drop("w")
    # Vectors with at least 1/heavy of all rows: at most ``heavy`` of them.
    total = distinct.agg(F.sum("rows")).first()[0]
    hot = distinct.where(F.col("rows") * heavy >= total).select("k1", "k2", F.lit(True).alias("hot"))
    keyed = rows.select("id", *_keys("x", seed)).join(F.broadcast(hot), ["k1", "k2"], "left")
    few = answers.join(F.broadcast(hot), ["k1", "k2"])
    joined = (keyed.where("hot").drop("hot").join(F.broadcast(few.drop("hot")), ["k1", "k2"])
              .unionByName(keyed.where("hot is null").drop("hot").join(answers, ["k1", "k2"])))
    return joined.select(F.col("id").alias(id_col), "n", "deviation", "z", "explained", "identity_error", F.col("d").alias("width"))


def whitened_components(df: DataFrame, **options) -> DataFrame:
    """:func:`whiten` with one row per component, numbered from 1."""
    w = whiten(df, **options)
    each = w.select("*", F.posexplode("z").alias("at", "whitened"))
    return each.select(F.col(w.columns[0]), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                       F.get("explained", F.col("at")).alias("explained"), "identity_error")
