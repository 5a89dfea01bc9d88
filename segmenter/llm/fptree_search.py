"""Ranked lexical search with document FP-trees and branch-and-bound.

Only the items' terms matter to a score, so every document is first cut down to
its restricted term vector: (term, tf) for the items' terms, the terms in order
of falling document frequency, and its length. One pass over the texts writes
these vectors in segments and sums up the corpus statistics (documents, terms,
document frequencies).

A segment's documents, sorted by their frequency-ordered vectors, form an
FP-tree: documents whose vectors begin alike share a path. The tree is unfolded
as far as a node has more than ``leaf`` documents; a node is a run of the sorted
documents. A node knows, for every term below it, the largest tf, and the
smallest m. As a score rises with tf and falls with m, the same formula over
these extremes is an upper bound for all documents below. Segments are walked
depth first, the child with the highest bounds first. At every node each item
goes on its own: it drops out where the node's bound is under the score of its
present last hit. Equal bounds go on, so ties by ``doc_id`` are right. The
documents of a leaf are scored exactly for the items that got there. Hits are
carried from segment to segment within a task, and the tasks' hits are merged by
a ranking in two steps, so no more than ``k`` rows an item and task are shuffled.

Bounds and scores of all items at a node are one matrix product over the node's
terms. It is done in doubles where every sum stays below 2**53, which makes it
exact, and in 64-bit integers otherwise.

Items go to the tasks in blocks whose matrix (items x terms) has a fixed bound;
more items only take more passes. Terms are compared by their 64-bit hashes.

Defined results: a null or empty text has no terms and is neither counted nor
ranked; an item without terms, or without a document of a score above 0, gives
no rows; rows that repeat an ``item_id`` are ranked each by itself; rows that
repeat a ``doc_id`` are documents of their own; a null ``doc_id`` comes after
all others of its score; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

VECTORS = "doc_ids binary, null_ids binary, lengths binary, starts binary, terms binary, tfs binary"
STATS = "term long, n long"
EXACT = float(1 << 53)


@dataclass
class Block:
    """A block of items: their distinct terms and how often each item holds each."""
    hashes: np.ndarray   # (T,) sorted term hashes
    counts: np.ndarray   # (T, I) occurrences, as doubles


def item_blocks(items: DataFrame, item_id: str, text: str, block_cells: int) -> tuple[DataFrame, int]:
    """(row, item_id, terms, counts) per item with terms, written, and the
    number of blocks that keep items x terms of a block near ``block_cells``."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows, terms, counts = [], [], []
            for r, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h, _, _ = tk.words(np.frombuffer((t or "").encode(), np.uint8), tk.ALNUM)
                if len(h):
                    u, c = np.unique(h, return_counts=True)
                    rows.append(r)
                    terms.append(tk.signed(u).tolist())
                    counts.append(c.tolist())
            yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int64())),
                                              "counts": pa.array(counts, pa.list_(pa.int64()))})

    src = tk.cut_lineage(items.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{item_id}`").alias("item_id"),
                                      F.col(f"`{text}`").cast("string").alias("text")), "items")
    cells = src.select("row", "text").mapInArrow(cut, "row long, terms array<long>, counts array<long>")
    table = tk.cut_lineage(src.select("row", "item_id").join(cells, "row"), "item_terms")
    r = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("t")).first()
    return table, max(1, math.ceil(math.sqrt((r["n"] or 0) * (r["t"] or 0) / block_cells)))


def read_block(rows: list) -> Block:
    hashes = np.unique(np.concatenate([np.array(r["terms"], np.int64).view(np.uint64) for r in rows]))
    counts = np.zeros((len(hashes), len(rows)))
    for i, r in enumerate(rows):
        counts[np.searchsorted(hashes, np.array(r["terms"], np.int64).view(np.uint64)), i] = r["counts"]
    return Block(hashes, counts)


def restricted_vectors(docs: DataFrame, hashes, segment_docs: int, segment_bytes: int) -> DataFrame:
    """Term vectors over the broadcast ``hashes`` (at least one), a row per
    segment, written. Documents without any such term have no vector; they are
    in the segment's sums ``n_docs`` and ``n_words``."""

    def build(batches):
        import pyarrow as pa

        q = hashes.value
        held: list[tuple] = []
        size = [0, 0, 0, 0]  # documents held, entries held, all documents, all words

        def segment():
            ids, null, n, per, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            cells = {"doc_ids": ids.astype(np.int64), "null_ids": null.astype(np.uint8), "lengths": n.astype(np.int64),
                     "starts": np.r_[0, np.cumsum(per)].astype(np.int64), "terms": terms.astype(np.int32), "tfs": tfs.astype(np.int32)}
            out = {k: pa.array([v.tobytes()], pa.binary()) for k, v in cells.items()}
            out |= {"n_docs": pa.array([size[2]], pa.int64()), "n_words": pa.array([size[3]], pa.int64())}
            held.clear()
            size[:] = [0] * 4
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                buf, off = tk.text_buffer(part.column("text"))
                h, rows, _ = tk.words_by_row(buf, off, tk.ALNUM)
                n = np.diff(rows)
                at = np.searchsorted(q, h)
                at[at == len(q)] = 0
                hit = np.flatnonzero(q[at] == h)
                doc = np.repeat(np.arange(len(n)), n)[hit]
                key, tf = np.unique(doc * len(q) + at[hit], return_counts=True)
                d, t = key // len(q), key % len(q)
                per = np.bincount(d, minlength=len(n))
                keep = per > 0
                ids = part.column("doc_id")
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False)[keep], np.asarray(ids.is_null())[keep], n[keep], per[keep], t, tf))
                for i, v in enumerate((int(keep.sum()), len(t), int((n > 0).sum()), int(n.sum()))):
                    size[i] += v
                if size[0] >= segment_docs or size[1] * 8 >= segment_bytes:
                    yield segment()
        if held:
            yield segment()

    rows = tk.documents(docs).mapInArrow(build, VECTORS + ", n_docs long, n_words long")
    return tk.cut_lineage(rows, "vectors")


def statistics(vectors: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, document frequency of each term): sums over the segments."""

    def count(batches):
        import pyarrow as pa

        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for row in tk.rows(batch):
                df += np.bincount(np.frombuffer(row["terms"], np.int32), minlength=n_terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen, pa.int64()), "n": pa.array(df[seen], pa.int64())})

    df = np.zeros(n_terms, np.int64)
    for r in vectors.select("terms").mapInArrow(count, STATS).groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    total = vectors.agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).first()
    return total["docs"] or 0, total["words"] or 0, df


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def length_norm(n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m of documents of ``n`` terms."""
    if 25 * int(n.max(initial=0)) * n_docs < 1 << 62:
        return 100 - 25 + (25 * n * n_docs) // n_words
    return np.array([100 - 25 + (25 * int(x) * n_docs) // n_words for x in n], np.int64)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """The FP-tree of a segment. Documents are sorted by their frequency-ordered
    vectors; a node is a run [lo, hi) of them that shares ``depth`` leading terms."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, rank: np.ndarray, weights: np.ndarray, leaf: int):
        # Terms in order of falling frequency, from 1; 0 stands past a vector's end.
        n, per = len(m), np.diff(starts)
        doc = np.repeat(np.arange(n), per)
        order = np.lexsort((rank[terms], doc))
        terms, tfs = terms[order].astype(np.int64), tfs[order].astype(np.int64)
        depth = min(int(per.max(initial=0)), 24)
        path = np.zeros((n, depth), np.int32)
        for j in range(depth):
            has = per > j
            path[has, j] = rank[terms[starts[:-1][has] + j]] + 1
        by = np.lexsort(path.T[::-1])
        self.docs, self.path, self.m = by, path[by], m[by]
        per = per[by]
        self.starts = np.r_[0, np.cumsum(per)]
        take = np.repeat(starts[:-1][by] - self.starts[:-1], per) + np.arange(len(terms))
        self.terms, self.tfs, self.weights, self.leaf = terms[take], tfs[take], weights, leaf
        self.width = len(weights)

    def bound_parts(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms below the run, their largest possible part of a score)."""
        t, tf = self.terms[self.starts[lo]:self.starts[hi]], self.tfs[self.starts[lo]:self.starts[hi]]
        most = np.zeros(self.width, np.int64)
        np.maximum.at(most, t, tf)
        seen = np.flatnonzero(most)
        return seen, self.weights[seen] * saturation(most[seen], self.m[lo:hi].min())

    def children(self, lo: int, hi: int, depth: int) -> list[tuple[int, int, int]]:
        """Runs of the next level (lo, hi, depth); neighbours that are small are
        taken together, runs that share all of the path are cut by number."""
        while depth < self.path.shape[1]:
            col = self.path[lo:hi, depth]
            cuts = np.flatnonzero(col[1:] != col[:-1]) + 1
            depth += 1
            if len(cuts):
                edges = [0]
                for c in [*cuts.tolist(), hi - lo]:
                    # A run joins its left neighbours while they fit in a leaf together.
                    if len(edges) > 1 and c - edges[-2] <= self.leaf:
                        edges[-1] = c
                    else:
                        edges.append(c)
                return [(lo + a, lo + b, depth if b - a > self.leaf else self.path.shape[1]) for a, b in zip(edges, edges[1:])]
        return [(a, min(hi, a + self.leaf), depth) for a in range(lo, hi, self.leaf)]

    def leaf_scores(self, lo: int, hi: int, counts: np.ndarray) -> np.ndarray:
        """Exact scores, documents x items."""
        a, b = self.starts[lo], self.starts[hi]
        t = self.terms[a:b]
        seen, col = np.unique(t, return_inverse=True)
        row = np.repeat(np.arange(hi - lo), np.diff(self.starts[lo:hi + 1]))
        parts = np.zeros((hi - lo, len(seen)), np.int64)
        parts[row, col] = self.weights[t] * saturation(self.tfs[a:b], self.m[lo:hi][row])
        return product(parts, counts[seen])


def product(parts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """parts @ counts, exact, as 64-bit integers."""
    if float(parts.max(initial=0)) * float(counts.sum(axis=0).max(initial=0)) < EXACT:
        return (parts.astype(np.float64) @ counts).astype(np.int64)
    return parts @ counts.astype(np.int64)


class Hits:
    """The ``k`` best (score, doc_id) of every item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64)] * items
        self.null = [np.empty(0, bool)] * items
        self.doc = [np.empty(0, np.int64)] * items
        self.floor = np.ones(items, np.int64)  # least score that can still enter

    def add(self, item: int, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        s, z, d = (np.concatenate(x) for x in ((self.score[item], score), (self.null[item], null), (self.doc[item], doc)))
        best = np.lexsort((d, z, -s))[:self.k]
        self.score[item], self.null[item], self.doc[item] = s[best], z[best], d[best]
        if len(best) == self.k:
            self.floor[item] = s[best[-1]]


def search_segment(tree: Tree, ids: np.ndarray, null: np.ndarray, counts: np.ndarray, hits: Hits) -> int:
    """Depth-first branch-and-bound of all items over one tree; returns how many
    documents were scored, summed over the items."""
    scored = 0
    everything = np.arange(counts.shape[1])
    seen, parts = tree.bound_parts(0, len(tree.m))
    stack = [(0, len(tree.m), 0, product(parts[None, :], counts[seen])[0], everything)]
    while stack:
        lo, hi, depth, bound, items = stack.pop()
        alive = bound >= hits.floor[items]  # the floor may have risen since the bound was taken
        items = items[alive]
        if not len(items):
            continue
        if hi - lo <= tree.leaf:
            scores = tree.leaf_scores(lo, hi, counts[:, items])
            scored += scores.size
            good = scores >= hits.floor[items]
            for j in np.flatnonzero(good.any(axis=0)).tolist():
                at = np.flatnonzero(good[:, j])
                docs = tree.docs[lo:hi][at]
                hits.add(int(items[j]), scores[at, j], null[docs], ids[docs])
            continue
        below = []
        for a, b, d in tree.children(lo, hi, depth):
            seen, parts = tree.bound_parts(a, b)
            bounds = product(parts[None, :], counts[seen][:, items])[0]
            below.append((int(bounds.max()), a, b, d, bounds))
        # The child with the highest bounds is on top of the stack.
        for _, a, b, d, bounds in sorted(below, key=lambda x: (x[0], -x[1])):
            stack.append((a, b, d, bounds, items))
    return scored


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text", leaf: int = 64,
                   segment_docs: int = 16_384, segment_bytes: int = 32 << 20, block_cells: int = 8_000_000) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    table, blocks = item_blocks(items, item_id, item_text, block_cells)
    found = None
    for b in range(blocks):
        part = table.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "terms", "counts").collect()
        if not part:
            continue
        block = read_block(part)
        vectors = restricted_vectors(docs, spark.sparkContext.broadcast(block.hashes), segment_docs, segment_bytes)
        n_docs, n_words, df = statistics(vectors, len(block.hashes))
        if not n_docs:
            break
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        sent = spark.sparkContext.broadcast((np.array([r["row"] for r in part], np.int64), block.counts, rank, term_weights(n_docs, df)))
        hits = vectors.select("doc_ids", "null_ids", "lengths", "starts", "terms", "tfs").mapInArrow(
            _searcher(sent, n_docs, n_words, k, leaf), "row long, doc_id long, score long")
        hits = tk.cut_lineage(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    kind = table.schema["item_id"].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Two steps: first within sixty-fourths of an item's hits, then over what is left of them.
    some = (found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
            .withColumn("at", F.row_number().over(Window.partitionBy("row", "salt").orderBy(*best))).where(F.col("at") <= k).drop("at", "salt"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.join(table.select("row", "item_id"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _searcher(sent, n_docs: int, n_words: int, k: int, leaf: int):
    def search(batches):
        import pyarrow as pa

        rows, counts, rank, weights = sent.value
        hits = Hits(len(rows), k)
        for batch in batches:
            for seg in tk.rows(batch):
                cell = {c: np.frombuffer(seg[c], kind) for c, kind in (
                    ("doc_ids", np.int64), ("null_ids", np.uint8), ("lengths", np.int64), ("starts", np.int64), ("terms", np.int32), ("tfs", np.int32))}
                if not len(cell["doc_ids"]):
                    continue
                tree = Tree(cell["starts"], cell["terms"], cell["tfs"], length_norm(cell["lengths"], n_docs, n_words), rank, weights, leaf)
                search_segment(tree, cell["doc_ids"], cell["null_ids"].astype(bool), counts, hits)
        for i, r in enumerate(rows.tolist()):
            n = len(hits.score[i])
            if n:
                yield pa.RecordBatch.from_pydict({"row": pa.array([r] * n, pa.int64()), "doc_id": pa.array(hits.doc[i], pa.int64(), mask=hits.null[i]),
                                                  "score": pa.array(hits.score[i], pa.int64())})

    return search
