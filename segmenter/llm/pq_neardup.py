"""Embedding near-duplicates with product quantisation.

Index: unit vectors are assigned to the nearest of the coarse centroids (the
inverted lists); the residual to the centroid is cut into subspaces, each coded
by the nearest entry of its codebook. Lists are kept by (label, width), since
only vectors with equal labels are compared. Every vector is indexed; centroids
and codebooks are fitted on a bounded sample of ``sample`` vectors.

Search: every distinct vector is a query. It probes every list that a vector
within reach can be in: only those are left out whose plane, half way between
their centroid and the query's own, is farther away than the wanted distance.
There is no bound on the number of lists, so no link is lost, and each is seen
from both of its ends. Neighbouring lists of a label are kept together in
regions of about ``block`` vectors, and a query is sent once to each region with
a list to probe. There, tables of products of the query with all codebook
entries give the asymmetric distance to every code by table look-ups. A code is
a candidate if its distance, less the stored quantisation error of that vector,
is within reach; by the triangle inequality no vector is lost. The candidates'
exact cosine, in double precision, decides. Vectors without any structure are
within reach of nearly all lists, so the work then grows with the square of a
label's distinct vectors.

Skew: equal vectors of a label are one node with a weight. Long regions are cut
into blocks of about ``block`` vectors, and the queries of a much-probed region
are dealt over several copies of the block. A task holds one block and streams
its queries; it emits one sum a query and the edges of a spanning forest of the
links it saw, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors without label or id link with nothing; vectors of
unequal widths are not compared; rows that repeat an id are one node when
components are formed; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of ``x`` and ``c``."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]
                          ) if len(x) else np.empty(0, np.int64)


class Quantiser:
    """Coarse centroids and residual codebooks for vectors of one width."""

    def __init__(self, x: np.ndarray, n_lists: int, subspaces: int = 8, entries: int = 128, seed: int = 7):
        coarse = kmeans(x, n_lists, 12, seed)
        # Lists that lie close get numbers that are close.
        self.coarse = coarse[np.argsort(nearest(coarse, kmeans(coarse, round(math.sqrt(len(coarse))), 8, seed + 2)), kind="stable")]
        rest = x - self.coarse[nearest(x, self.coarse)]
        self.cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        self.books = [kmeans(np.ascontiguousarray(rest[:, a:b]), entries, 8, seed + 1)
                      for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, quantisation error) of unit vectors."""
        lists = nearest(x, self.coarse)
        rest = x - self.coarse[lists]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        err = np.zeros(len(x))
        for j, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            part = np.ascontiguousarray(rest[:, a:b])
            codes[:, j] = nearest(part, self.books[j])
            err += ((part - self.books[j][codes[:, j]]) ** 2).sum(1)
        return lists, codes, np.sqrt(err)

    def region(self, lists: np.ndarray, n: int) -> np.ndarray:
        """Region of each list, of ``n`` regions (at most one a list)."""
        return lists * min(n, len(self.coarse)) // len(self.coarse)

    def probes(self, x: np.ndarray, n: int, reach: float) -> list[np.ndarray]:
        """For each vector all those of ``n`` regions that hold a list within reach."""
        first = np.flatnonzero(np.diff(self.region(np.arange(len(self.coarse)), n), prepend=-1))
        gap = np.sqrt(distances(self.coarse, self.coarse))
        out = []
        for i in range(0, len(x), 1024):
            d = distances(x[i:i + 1024], self.coarse)
            own = d.argmin(1)
            plane = (d - d.min(1)[:, None]) / (2 * np.maximum(gap[own], 1e-12))
            near = plane <= reach + 1e-9
            near[np.arange(len(d)), own] = True
            out += [np.flatnonzero(r).astype(np.int32) for r in np.logical_or.reduceat(near, first, axis=1)]
        return out

    def lengths(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared lengths of the vectors that the codes stand for."""
        x = self.coarse[lists] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return (x * x).sum(1)

    def approximate(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances from queries to codes of any lists."""
        dot = np.take(q @ self.coarse.T, lists, axis=1)
        for j, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            dot += np.take(q[:, a:b] @ self.books[j].T, codes[:, j], axis=1)
        return (q * q).sum(1)[:, None] + lengths[None] - 2 * dot


def _valid(v) -> F.Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) > 0) & finite & some, F.lit(False))


def _unit(raw: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(raw, np.float64)
    # Scale first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), x


def link_vectors(vectors: DataFrame, cosine: float = 0.93, sample: int = 16_384, block: int = 2_048,
                 queries: int = 32_768) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    reach = math.sqrt(2 - 2 * cosine)
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                         F.col("embedding").cast("array<double>").alias("v"))
    ok = _valid(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    src = src.withColumn("ok", ok)
    # One node for equal vectors of a label; its id is the smallest vec_id.
    nodes = tk.cut_lineage(src.where("ok").groupBy("label", "v").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")).withColumn("width", F.size("v")), "nodes")
    widths = {r["width"]: r["n"] for r in nodes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted = {}
    for width, n in widths.items():
        rows = (nodes.where(F.col("width") == width).select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).collect())
        x, _ = _unit([r["v"] for r in rows])
        fitted[width] = Quantiser(x, max(1, min(round(math.sqrt(n)), len(x), 4096)))
    sent = spark.sparkContext.broadcast(fitted)
    per_label = nodes.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("regions"))

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            kinds = np.stack([np.asarray(batch.column("width")), np.asarray(batch.column("regions"))], axis=1)
            for width, regions in np.unique(kinds, axis=0).tolist():
                part = batch.filter(pa.array((kinds == [width, regions]).all(axis=1)))
                x, _ = _unit(part.column("v").to_pylist())
                q = sent.value[width]
                lists, codes, err = q.encode(x)
                yield pa.RecordBatch.from_pydict({
                    "label": part.column("label"), "width": part.column("width"), "node": part.column("node"),
                    "weight": part.column("weight"), "list": pa.array(lists.astype(np.int32)),
                    "region": pa.array(q.region(lists, regions).astype(np.int32)),
                    "probes": pa.array(q.probes(x, regions, reach), pa.list_(pa.int32())),
                    "vector": pa.array([r.tobytes() for r in x], pa.binary()),
                    "codes": pa.array([r.tobytes() for r in codes], pa.binary()), "error": pa.array(err)})

    coded = tk.cut_lineage(nodes.join(per_label, ["label", "width"]).select("label", "width", "regions", "node", "weight", "v").mapInArrow(
        index, "label string, width int, node long, weight long, list int, region int, probes array<int>, vector binary, "
               "codes binary, error double"), "coded")
    key = ["label", "width", "region"]
    asked = coded.select("label", "width", F.explode("probes").alias("region"), "node", "vector")
    # Blocks of a region, and copies of its blocks for the queries.
    blocks = F.greatest(F.round(F.col("n") / block), F.lit(1)).cast("int")
    sizes = coded.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, blocks.alias("blocks"))
    loads = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, F.ceil(F.col("n") / queries).cast("int").alias("copies"))
    plan = tk.cut_lineage(sizes.join(loads, key), "regions")
    held = (coded.join(plan, key).select(
        *key, F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("tag"), "node", "weight", "list",
        "vector", "codes", "error"))
    sought = (asked.join(plan, key).select(
        *key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("node", F.lit(1)), "copies").cast("int").alias("copy"), F.lit(1).alias("tag"), "node",
        F.lit(0).cast("long").alias("weight"), F.lit(None).cast("int").alias("list"), "vector",
        F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error")))
    at = [*key, "block", "copy"]
    met = held.unionByName(sought).repartition(*at).sortWithinPartitions(*at, "tag").mapInArrow(
        _matcher(sent, cosine, reach), "node long, links long, other long")
    found = tk.cut_lineage(met, "links")
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = tk.connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    per_node = (nodes.join(links, "node", "left").join(parts.withColumnRenamed("id", "node"), "node", "left")
                .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                        F.coalesce("component", "node").alias("component_id")))
    return (src.withColumn("key", F.when(F.col("ok"), F.col("v"))).drop("v")
            .join(per_node.withColumnRenamed("v", "key"), ["label", "key"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def _matcher(sent, cosine: float, reach: float):
    def match(batches):
        import pyarrow as pa

        now, block, fresh = None, None, []

        def close():
            """The block's vectors, once all of them are there."""
            rows = [r for part in fresh for r in part]
            lists, codes = np.array([r[5] for r in rows]), np.stack([np.frombuffer(r[3], np.uint8) for r in rows])
            return {"node": np.array([r[0] for r in rows], np.int64), "weight": np.array([r[1] for r in rows], np.int64),
                    "x": np.stack([np.frombuffer(r[2]) for r in rows]), "lists": lists, "codes": codes,
                    "lengths": sent.value[now[1]].lengths(lists, codes),
                    "limit": (reach + np.array([r[4] for r in rows]) + 1e-9) ** 2, "root": np.arange(len(rows))}

        def root(b, i):
            r = b["root"]
            while r[i] != i:
                r[i] = r[r[i]]
                i = r[i]
            return i

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("label", "width", "region", "block", "copy", "tag", "node", "weight", "list")}
            raw = {c: batch.column(c) for c in ("vector", "codes", "error")}
            keys = list(zip(*(cols[c] for c in ("label", "width", "region", "block", "copy", "tag")), strict=True))
            nodes, sums, others = [], [], []
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i][:5] != now:
                    now, block, fresh = keys[i][:5], None, []
                if keys[i][5] == 0:
                    fresh.append([(cols["node"][k], cols["weight"][k], raw["vector"][k].as_py(), raw["codes"][k].as_py(),
                                   raw["error"][k].as_py(), cols["list"][k]) for k in range(i, j)])
                elif fresh:
                    if block is None:
                        block = close()
                    quantiser = sent.value[now[1]]
                    for a in range(i, j, 512):
                        b = min(j, a + 512)
                        q = np.stack([np.frombuffer(raw["vector"][k].as_py()) for k in range(a, b)])
                        own = np.array(cols["node"][a:b], np.int64)
                        near = quantiser.approximate(q, block["lists"], block["codes"], block["lengths"]) <= block["limit"]
                        row, col = np.nonzero(near & (own[:, None] != block["node"][None]))
                        if not len(row):
                            continue
                        sim = np.einsum("ij,ij->i", q[row], block["x"][col])
                        row, col = row[sim >= cosine], col[sim >= cosine]
                        total = np.bincount(row, weights=block["weight"][col], minlength=b - a).astype(np.int64)
                        for k in np.flatnonzero(total).tolist():
                            mates = col[row == k].tolist()
                            nodes.append(int(own[k]))
                            sums.append(int(total[k]))
                            others.append(int(block["node"][mates[0]]))
                            # Mates that were apart so far: an edge for each that joins the first.
                            top = root(block, mates[0])
                            for m in mates[1:]:
                                r = root(block, m)
                                if r != top:
                                    block["root"][r] = top
                                    nodes.append(int(block["node"][m]))
                                    sums.append(None)
                                    others.append(int(block["node"][mates[0]]))
                i = j
            if nodes:
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "links": pa.array(sums, pa.int64()),
                                                  "other": pa.array(others, pa.int64())})

    return match
