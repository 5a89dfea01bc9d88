"""Benchmark decontamination with a distributed positional inverted index.

Index: the corpus is cut into segments of whole documents. Every segment stores
its own inverted index as one row: the sorted distinct terms (64-bit word
hashes), their posting offsets, and the postings, which are word positions in
the segment. One unused position lies between two documents, so consecutive
positions never cross a document. Segments are built side by side, without a
shuffle, and written as Parquet under the shared checkpoint folder; a lost
executor costs only its own segments.

Search: the corpus frequency of every test term is summed over the segments.
An exact phrase of n terms starts from the posting list of its rarest term,
moved back by the term's offset in the phrase, and intersects it with the
equally moved lists of the next rarer terms. A proximity match starts from the
rarest term as well and keeps the places where every other term of the phrase
stands within ``slop`` positions in the same document; a word that the phrase
repeats need not be repeated there. Test phrases are sent to the tasks in blocks
of at most ``block_windows``, so what is broadcast has a fixed bound and a
larger benchmark only takes more passes over the index.

Terms are compared by their 64-bit hashes.

Defined results: null or empty texts have no words (n_words 0, no hit); a null
``doc_id`` keeps its row; repeated rows give repeated result rows; equal items
each count; an item without words is ignored; an empty corpus gives no rows; an
empty benchmark gives rows without hits; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import free_names
from . import textkit as tk

INDEX_SCHEMA = ("segment long, doc_ids binary, null_ids binary, doc_starts binary, "
                "terms binary, offsets binary, postings binary")
RESULT_SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
                 "contaminated boolean, n_near long")


def build_index(docs: DataFrame, segment_bytes: int = 4 << 20) -> DataFrame:
    """Positional index of ``docs`` (doc_id, text), one row per segment."""

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            for part in tk.slices(batch, "text", segment_bytes):
                buf, off = tk.text_buffer(part.column("text"))
                h, rows, _ = tk.words_by_row(buf, off, tk.ALNUM)
                n = len(rows) - 1
                pos = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(rows))
                order = np.argsort(h, kind="stable")
                hs = h[order]
                first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]) if len(hs) else np.empty(0, np.int64)
                ids = part.column("doc_id")
                cells = {
                    "segment": 0,
                    "doc_ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                    "null_ids": np.asarray(ids.is_null()).astype(np.uint8).tobytes(),
                    # First position of each document, and one past the last.
                    "doc_starts": (rows + np.arange(n + 1)).astype(np.int64).tobytes(),
                    "terms": hs[first].tobytes(),
                    "offsets": np.r_[first, len(hs)].astype(np.int32).tobytes(),
                    "postings": pos[order].astype(np.int32).tobytes(),
                }
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64() if k == "segment" else pa.binary())
                                                  for k, v in cells.items()})

    rows = tk.documents(docs).mapInArrow(build, INDEX_SCHEMA)
    return tk.cut_lineage(rows.withColumn("segment", F.monotonically_increasing_id()), "positions")


def _windows(items: DataFrame, n: int) -> DataFrame:
    """(item_id, phrase): every run of n consecutive words of an item as an
    array of term hashes; an item with fewer words, but not none, is one."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h, _, _ = tk.words(np.frombuffer((t or "").encode(), np.uint8), tk.ALNUM)
                s = tk.signed(h)
                for k in range(max(1, len(s) - n + 1) if len(s) else 0):
                    ids.append(i)
                    out.append(s[k:k + n].tolist())
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.string()),
                                              "phrase": pa.array(out, pa.list_(pa.int64()))})

    src = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(cut, "item_id string, phrase array<long>")


def _cell(row: dict, name: str, kind) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def term_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Corpus frequency of each of ``terms`` (a bounded block of test terms)."""
    spark = index.sparkSession
    wanted = spark.sparkContext.broadcast(np.sort(terms))

    def count(batches):
        import pyarrow as pa

        q = wanted.value
        total = np.zeros(len(q), np.int64)
        for batch in batches:
            for row in tk.rows(batch):
                t, off = _cell(row, "terms", np.uint64), _cell(row, "offsets", np.int32)
                at = np.searchsorted(t, q)
                at[at == len(t)] = 0
                if len(t):
                    hit = t[at] == q
                    total[hit] += (off[at + 1] - off[at])[hit]
        seen = total > 0
        yield pa.RecordBatch.from_pydict({"term": pa.array(tk.signed(q[seen])), "n": pa.array(total[seen])})

    rows = (index.select("terms", "offsets").mapInArrow(count, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())
    return {r["term"] & (2**64 - 1): r["n"] for r in rows}


class Phrases:
    """A block of test phrases, ready to be searched in a segment."""

    def __init__(self, phrases: list[tuple], counts: dict[int, int], slop: int):
        self.slop = slop
        self.lens = np.array([len(p) for p in phrases], np.int64)
        width = int(self.lens.max()) if len(phrases) else 1
        terms = np.zeros((len(phrases), width), np.uint64)
        freq = np.full((len(phrases), width), np.iinfo(np.int64).max)
        for i, p in enumerate(phrases):
            terms[i, :len(p)] = np.array([x & (2**64 - 1) for x in p], np.uint64)
            freq[i, :len(p)] = [counts.get(x & (2**64 - 1), 0) for x in p]
        self.valid = np.arange(width)[None, :] < self.lens[:, None]
        self.terms = terms
        # Offsets of a phrase's terms, from the corpus' rarest term to the commonest.
        self.order = np.argsort(freq, axis=1, kind="stable")
        self.flat, back = np.unique(terms, return_inverse=True)
        self.back = back.reshape(terms.shape)

    def search(self, terms: np.ndarray, off: np.ndarray, post: np.ndarray, doc_starts: np.ndarray, near: bool):
        """Yields (phrase, exact start positions, places of the rarest term of a near match)."""
        if not len(terms) or not len(self.lens):
            return
        at = np.searchsorted(terms, self.flat)
        at[at == len(terms)] = 0
        known = terms[at] == self.flat
        possible = (known[self.back] | ~self.valid).all(axis=1)
        for i in np.flatnonzero(possible):
            n = int(self.lens[i])
            slot, order = at[self.back[i]], self.order[i, :n]
            k = order[0]
            lead = post[off[slot[k]]:off[slot[k] + 1]].astype(np.int64)
            starts = lead - k
            for k2 in order[1:]:
                if not len(starts):
                    break
                other = post[off[slot[k2]]:off[slot[k2] + 1]]
                j = np.searchsorted(other, starts + k2)
                j[j == len(other)] = 0
                starts = starts[other[j] == starts + k2]
            close = np.empty(0, np.int64)
            if near and n > 1:
                # The other terms must stand within slop positions and in the same document.
                doc = np.searchsorted(doc_starts, lead, "right")
                close, low, high = lead, np.maximum(lead - self.slop, doc_starts[doc - 1]), np.minimum(lead + self.slop, doc_starts[doc] - 1)
                for k2 in order[1:]:
                    other = post[off[slot[k2]]:off[slot[k2] + 1]]
                    j = np.searchsorted(other, low)
                    j[j == len(other)] = 0
                    meets = (other[j] >= low) & (other[j] <= high)
                    close, low, high = close[meets], low[meets], high[meets]
                    if not len(close):
                        break
            if len(starts) or len(close):
                yield int(i), starts, close


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, slop: int = 0,
                  segment_bytes: int = 4 << 20, block_windows: int = 200_000) -> DataFrame:
    """One row per document: n_words, n_hit (words inside an occurrence of an
    item's n-word window), n_items, items_sha256 (of the sorted item ids that
    occur), contaminated, n_near (places where a window's words all stand
    within ``slop`` positions of its rarest word; null unless ``slop`` is set).
    """
    spark = docs.sparkSession
    index = build_index(docs, segment_bytes)
    grouped = (_windows(items, n).groupBy("phrase").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    windows = tk.cut_lineage(grouped.withColumn("_r", F.xxhash64("phrase")), "windows")
    total = windows.count()
    blocks = max(1, -(-total // block_windows))
    hits = None
    for b in range(blocks):
        part = windows.where(F.pmod(F.col("_r"), F.lit(blocks)) == b).select("phrase", "items").collect()
        phrases = [tuple(r["phrase"]) for r in part]
        counts = term_counts(index, np.unique(np.array([x & (2**64 - 1) for p in phrases for x in p], np.uint64))
                             ) if phrases else {}
        sent = spark.sparkContext.broadcast((Phrases(phrases, counts, slop), [r["items"] for r in part]))
        found = index.mapInArrow(_searcher(sent, n, slop > 0, blocks == 1), _HIT if blocks > 1 else RESULT_SCHEMA)
        if blocks == 1:
            return found
        found = tk.cut_lineage(found, "hits")
        hits = found if hits is None else hits.unionByName(found)
    # Several blocks: put a document's spans and items from all blocks together.
    merged = hits.groupBy("segment", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.sum("n_near").alias("n_near"))
    return merged.mapInArrow(_finish, RESULT_SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; all columns stay.

    Hits are looked up by id and text hash, so rows that repeat an id with
    another text are judged by their own text.
    """
    k = free_names(docs, "_k")[0]
    keyed = docs.withColumn(k, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    hit = decontaminate(keyed.select(F.col(k).alias("doc_id"), "text"), items, n).where("contaminated")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return keyed.join(hit.select(F.col("doc_id").alias(k)).distinct(), k, "left_anti").select(*names)


_HIT = "segment long, doc long, doc_id long, n_words long, spans array<long>, items array<string>, n_near long"


def _covered(spans: list[int]) -> int:
    """Words covered by (start, end, start, end, ...) spans."""
    s = np.asarray(spans, np.int64).reshape(-1, 2)
    if not len(s):
        return 0
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    before = np.r_[s[0, 0], reach[:-1]]
    return int(np.maximum(0, s[:, 1] - np.maximum(s[:, 0], before)).sum())


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _finish(batches):
    import pyarrow as pa

    for batch in batches:
        rows = batch.to_pylist()
        yield _result_batch(pa, [r["doc_id"] for r in rows], [r["n_words"] for r in rows],
                            [_covered(r["spans"]) for r in rows], [sorted(r["items"]) for r in rows],
                            [r["n_near"] for r in rows])


def _result_batch(pa, ids, n_words, n_hit, items, near):
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items_sha256": pa.array([_digest(x) for x in items], pa.string()),
        "contaminated": pa.array([x > 0 for x in n_hit], pa.bool_()), "n_near": pa.array(near, pa.int64())})


def _searcher(sent, n: int, near: bool, final: bool):
    def search(batches):
        import pyarrow as pa

        block, items_of = sent.value
        for batch in batches:
            for row in tk.rows(batch):
                starts = _cell(row, "doc_starts", np.int64)
                ids = _cell(row, "doc_ids", np.int64)
                null = _cell(row, "null_ids", np.uint8).astype(bool)
                spans: dict[int, list[int]] = {}
                found: dict[int, set] = {}
                close = np.zeros(len(ids), np.int64)
                for i, exact, near_at in block.search(_cell(row, "terms", np.uint64), _cell(row, "offsets", np.int32),
                                                      _cell(row, "postings", np.int32), starts, near):
                    # Empty documents own one position only, so the last start not after it is right.
                    for s, d in zip(exact.tolist(), (np.searchsorted(starts, exact, "right") - 1).tolist(), strict=True):
                        spans.setdefault(d, []).extend((s, s + int(block.lens[i])))
                        found.setdefault(d, set()).update(items_of[i])
                    if len(near_at):
                        np.add.at(close, np.searchsorted(starts, near_at, "right") - 1, 1)
                doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
                n_words = (np.diff(starts) - 1).tolist()
                near_n = close.tolist() if near else [None] * len(ids)
                if final:
                    yield _result_batch(pa, doc_ids, n_words, [_covered(spans.get(d, [])) for d in range(len(ids))],
                                        [found.get(d, ()) for d in range(len(ids))], near_n)
                else:
                    yield pa.RecordBatch.from_pydict({
                        "segment": pa.array([row["segment"]] * len(ids), pa.int64()),
                        "doc": pa.array(range(len(ids)), pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()),
                        "n_words": pa.array(n_words, pa.int64()),
                        "spans": pa.array([spans.get(d, []) for d in range(len(ids))], pa.list_(pa.int64())),
                        "items": pa.array([sorted(found.get(d, ())) for d in range(len(ids))], pa.list_(pa.string())),
                        "n_near": pa.array(near_n, pa.int64())})

    return search
