"""Deleted-interpolation language model.

p(w | h) mixes three estimates: the bigram maximum-likelihood estimate
c(h, w) / c(h), the unigram estimate c(w) / N, and the uniform 1 / (V + 1) (one
class more than the known words, for all unknown ones). The mixture weights
depend on the bucket of the context's frequency (its power of two) and are
learned by expectation-maximisation on deleted counts: every training bigram is
held out of the counts once, so it is explained by c(h, w) - 1, c(h) - 1,
c(w) - 1 and N - 1.

Work on Spark:

1. Documents are tokenised in blocks of about ``block_bytes``. A block's tokens
   are a file in the shared checkpoint folder. Its distinct unigram and bigram
   hashes, sorted, with their training counts, go out by hash range.
2. Every hash range adds up the counts of all blocks (partial sums were made in
   the blocks, so a word that is in every document is one key a block) and
   answers every block with the corpus counts of its keys.
3. A block's answers meet its file. One pass gathers the deleted counts, as a
   histogram over (context bucket, rounded logarithms of the estimates), for
   the weights; the next scores every document.

The histogram has a fixed number of cells at any input size (32 buckets, 1/4
bits of resolution), so it may go to the driver; all training bigrams are in it.

Words are compared by 64-bit hashes, bigrams by their hash range and 48 bits
within it.

Defined results: a null or empty text is a single end token; a null ``doc_id``
counts as training text; repeated rows count repeatedly; an empty table gives no
rows; with no training text all estimates but the uniform one are 0; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tokenpack import bits_for, open_store, pack, unpack

_END, _START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
_BUCKETS, _STEPS = 32, 4  # context buckets; cells a bit of the logarithm
_LOW = 44 * _STEPS  # estimates below 2**-44 share the last cell


def _pairs(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    return tk.mix(tk.mix(prev + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93) + cur)


class Block:
    """Tokens of a run of documents, kept as a file in the shared store: the
    distinct words, and each token's place among them in the fewest bits."""

    FIELDS = (("doc_ids", "<i8"), ("null", "u1"), ("held", "u1"), ("starts", "<i8"), ("uni", "<u8"), ("places", "<u8"))

    def __init__(self, ids, null, held, starts, uni, at):
        self.doc_ids, self.null, self.held, self.starts, self.uni, self.at = ids, null, held, starts, uni, at

    def write(self, store, folder: str, stem: str) -> str:
        """Writes the file and returns its name, which tells its contents."""
        bits = bits_for(max(len(self.uni), 1))
        places = np.frombuffer(pack(self.at, bits), "<u8")
        parts = [np.ascontiguousarray(x).astype(kind, copy=False) for x, (_, kind) in zip(
            (self.doc_ids, self.null, self.held, self.starts, self.uni, places), self.FIELDS, strict=True)]
        data = [np.array([bits, len(self.at), *map(len, parts)], "<i8").tobytes(), *(p.tobytes() for p in parts)]
        digest = hashlib.blake2b(digest_size=16)
        for d in data:
            digest.update(d)
        name = f"{stem}-{digest.hexdigest()}.tok"
        with store.open_output_stream(f"{folder}/{name}") as out:
            for d in data:
                out.write(d)
        return name

    @classmethod
    def read(cls, store, path: str) -> Block:
        with store.open_input_file(path) as f:
            bits, n, *lens = np.frombuffer(f.read(8 * (2 + len(cls.FIELDS))), "<i8").tolist()
            x = [np.frombuffer(f.read(np.dtype(k).itemsize * m), k) for (_, k), m in zip(cls.FIELDS, lens, strict=True)]
        return cls(x[0], x[1].astype(bool), x[2].astype(bool), x[3], x[4], unpack(x[5].tobytes(), bits, n))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, word before) of every token, as hashes."""
        cur = self.uni[self.at]
        prev = np.empty_like(cur)
        prev[1:] = cur[:-1]
        prev[self.starts[:-1]] = _START
        return cur, prev


def _read_block(parts) -> Block:
    import pyarrow as pa

    ids = pa.concat_arrays([p.column("doc_id") for p in parts])
    held = np.concatenate([np.asarray(p.column("held")) for p in parts]).astype(bool)
    hs, lens = [], []
    for p in parts:
        buf, off = tk.text_buffer(p.column("text"))
        h, rows, _ = tk.words_by_row(buf, off, tk.SPACED)
        hs.append(h)
        lens.append(np.diff(rows))
    n = np.concatenate(lens) + 1
    starts = np.r_[0, np.cumsum(n)]
    words = np.full(int(starts[-1]), _END, np.uint64)
    is_word = np.ones(len(words), bool)
    is_word[starts[1:] - 1] = False
    words[is_word] = np.concatenate(hs)
    uni, at = np.unique(words, return_inverse=True)
    return Block(ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()), held, starts, uni, at)


def _short(keys: np.ndarray, kind: int) -> bytes:
    """Bigram keys of a hash range leave out their two high bytes, of which the
    range tells the better part."""
    return keys.tobytes() if kind == 0 else keys.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw: bytes, kind: int) -> np.ndarray:
    if kind == 0:
        return np.frombuffer(raw, np.uint64)
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Sorted keys cut into hash ranges of equal width."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def corpus_counts(docs: DataFrame, held_out, folder: str, block_bytes: int, keys_per_range: int) -> DataFrame:
    """(block, kind, part, counts, known, total): for each block file, kind (0
    unigrams, 1 bigrams) and hash range, the corpus counts of the block's keys
    in that range, in key order; and per range its number of known keys and
    their total count. Writes the block files to ``folder``."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      held_out.alias("held"))
    size = src.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    ranges = max(1, -(-(size // 7) // keys_per_range))  # about a key for every seven bytes

    def deal(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = open_store(folder)
        pid, seq = TaskContext.get().partitionId(), itertools.count()

        def send(parts):
            block = _read_block(parts)
            # A repeated task sends the same names and writes the same bytes, so ranges that
            # finished before a map output was lost and those that run after agree.
            name = block.write(store, root, f"{pid:06d}-{next(seq):05d}")
            cur, prev = block.words()
            train = np.repeat(~block.held, np.diff(block.starts))
            uni_n = np.bincount(block.at, weights=train, minlength=len(block.uni))
            # The start of a text is a context only: its count is the number of training texts.
            uni, uni_n = np.r_[block.uni, _START], np.r_[uni_n, (~block.held).sum()]
            order = np.argsort(uni)
            bi, at = np.unique(_pairs(prev, cur), return_inverse=True)
            out = {"part": [], "kind": [], "keys": [], "n": []}
            for kind, (keys, n) in enumerate(((uni[order], uni_n[order]), (bi, np.bincount(at, weights=train, minlength=len(bi))))):
                cut = _cuts(keys, ranges)
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    out["part"].append(i)
                    out["kind"].append(kind)
                    out["keys"].append(_short(keys[cut[i]:cut[i + 1]], kind))
                    out["n"].append(n[cut[i]:cut[i + 1]].astype(np.uint32).tobytes())
            return pa.RecordBatch.from_pydict({
                "part": pa.array(out["part"], pa.int32()), "block": pa.array([name] * len(out["part"]), pa.string()),
                "kind": pa.array(out["kind"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()),
                "n": pa.array(out["n"], pa.binary())})

        held_rows, held_size = [], 0
        for batch in batches:
            for part in tk.slices(batch, "text", 1 << 20):
                held_rows.append(part)
                held_size += tk.text_buffer(part.column("text"))[1][-1]
                if held_size >= block_bytes:
                    yield send(held_rows)
                    held_rows, held_size = [], 0
        if held_rows:
            yield send(held_rows)

    def add_up(key, pdf):
        import pandas as pd

        keys = [_long(k, key[1]) for k in pdf["keys"]]
        lens = [len(k) for k in keys]
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["n"]])
        distinct, group = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(group, weights=n).astype(np.int64)
        answer = np.split(total[group], np.cumsum(lens)[:-1])
        # The start symbol is a context, not a token.
        token = distinct != _START if key[1] == 0 else np.ones(len(total), bool)
        known, count = int(((total > 0) & token).sum()), int(total[token].sum())
        return pd.DataFrame({"block": pdf["block"], "kind": pdf["kind"], "part": pdf["part"],
                             "counts": [a.tobytes() for a in answer],
                             "known": [known] + [0] * (len(lens) - 1), "total": [count] + [0] * (len(lens) - 1)})

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    dealt = src.mapInArrow(deal, "part int, block string, kind int, keys binary, n binary")
    return tk.cut_lineage(dealt.groupBy("part", "kind").applyInPandas(
        add_up, "block string, kind int, part int, counts binary, known long, total long"), "lm_counts")


class _Estimates:
    """Counts behind every token of a block."""

    def __init__(self, row: dict, store, root: str):
        b = Block.read(store, f"{root}/{row['block']}")
        self.starts, self.ids, self.null, self.held = b.starts, b.doc_ids, b.null, b.held
        answers = {0: [], 1: []}
        for a in sorted(row["answers"], key=lambda a: (a["kind"], a["part"])):
            answers[a["kind"]].append(np.frombuffer(a["counts"], np.int64))
        uni = np.sort(np.r_[b.uni, _START])
        counts = np.concatenate(answers[0])
        cur, prev = b.words()
        self.c_w = counts[np.searchsorted(uni, b.uni)][b.at].astype(np.float64)
        _, at = np.unique(_pairs(prev, cur), return_inverse=True)
        self.c_hw = np.concatenate(answers[1])[at].astype(np.float64)
        self.c_h = np.empty_like(self.c_w)
        self.c_h[1:] = self.c_w[:-1]
        self.c_h[self.starts[:-1]] = float(counts[np.searchsorted(uni, _START)])


def _bucket(c_h: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(c_h, 1)).astype(np.int64) + (c_h >= 1), 0, _BUCKETS - 1)


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for an estimate of zero, else 1 + its rounded negative logarithm."""
    with np.errstate(divide="ignore"):
        x = np.round(-np.log2(p) * _STEPS)
    return np.where(p > 0, 1 + np.clip(x, 0, _LOW), 0).astype(np.int64)


def _value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 2.0 ** (-(cell - 1) / _STEPS), 0.0)


def learn_weights(histogram: list[tuple[int, int, int, int]], v: int, rounds: int = 50) -> np.ndarray:
    """(buckets, 3) weights of the bigram, unigram and uniform estimates by
    expectation-maximisation; ``histogram``: (bucket, bigram cell, unigram
    cell, count). Buckets without held-out bigrams rely on the lower orders."""
    w = np.tile(np.array([0.0, 0.9, 0.1]), (_BUCKETS, 1))
    h = np.asarray(histogram, np.int64).reshape(-1, 4)
    for b in np.unique(h[:, 0]):
        part = h[h[:, 0] == b]
        p = np.stack([_value(part[:, 1]), _value(part[:, 2]), np.full(len(part), 1.0 / (v + 1))], axis=1)
        weight, n = np.array([0.4, 0.5, 0.1]), part[:, 3].astype(np.float64)
        for _ in range(rounds):
            joint = p * weight
            weight = (joint / joint.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            weight = np.maximum(weight, 1e-6)  # no estimate is ever ruled out
            weight /= weight.sum()
        w[b] = weight
    w[0] = [0.0, *(w[0, 1:] / w[0, 1:].sum())]  # an unseen context has no bigram estimate
    return w


def score_documents(docs: DataFrame, held_out, block_bytes: int = 8 << 20,
                    keys_per_range: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigram) and score (the mixture), base-10 logarithms, of every document."""
    spark = docs.sparkSession
    folder = tk.scratch_path(spark, "lm_blocks")
    counts = corpus_counts(docs, held_out, folder, block_bytes, keys_per_range)
    seen = counts.where("kind = 0").agg(F.sum("total").alias("n"), F.sum("known").alias("v")).head()
    n, v = int(seen["n"] or 0), int(seen["v"] or 0)
    # One block a partition, so that a task holds the answers of one block at a time.
    n_blocks = max(1, counts.select("block").distinct().count())
    joined = counts.repartition(n_blocks, "block").groupBy("block").agg(F.collect_list(F.struct("kind", "part", "counts")).alias("answers"))

    def deleted(batches):
        import pyarrow as pa

        store, root = open_store(folder)
        cells: dict[int, int] = {}
        side = _LOW + 2
        for batch in batches:
            for row in tk.rows(batch):
                e = _Estimates(row, store, root)
                train = np.repeat(~e.held, np.diff(e.starts))
                c_hw, c_h, c_w = e.c_hw[train], e.c_h[train], e.c_w[train]
                p2 = np.where(c_h > 1, (c_hw - 1) / np.maximum(c_h - 1, 1), 0)
                p1 = (c_w - 1) / max(n - 1, 1)
                key = (_bucket(c_h - 1) * side + _cell(p2)) * side + _cell(p1)
                for k, m in zip(*(x.tolist() for x in np.unique(key, return_counts=True)), strict=True):
                    cells[k] = cells.get(k, 0) + m
        yield pa.RecordBatch.from_pydict({"cell": pa.array(list(cells), pa.int64()),
                                          "n": pa.array(list(cells.values()), pa.int64())})

    side = _LOW + 2
    histogram = [(r["cell"] // side // side, r["cell"] // side % side, r["cell"] % side, r["n"]) for r in
                 joined.mapInArrow(deleted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()]
    weights = spark.sparkContext.broadcast(learn_weights(histogram, v))

    def score(batches):
        import pyarrow as pa

        store, root = open_store(folder)
        for batch in batches:
            for row in tk.rows(batch):
                e = _Estimates(row, store, root)
                w = weights.value[_bucket(e.c_h)]
                p = (w[:, 0] * np.where(e.c_h > 0, e.c_hw / np.maximum(e.c_h, 1), 0) + w[:, 1] * e.c_w / max(n, 1)
                     + w[:, 2] / (v + 1))
                base = np.log10((e.c_w + 1) / (n + v + 1))
                at = e.starts[:-1]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(e.ids, pa.int64(), mask=e.null), "held_out": pa.array(e.held),
                    "n_tokens": pa.array(np.diff(e.starts)),
                    "n_known": pa.array(np.add.reduceat(e.c_w > 0, at, dtype=np.int64)),
                    "train_tokens": pa.array(np.full(len(at), n, np.int64)),
                    "base_score": pa.array(np.add.reduceat(base, at)), "score": pa.array(np.add.reduceat(np.log10(p), at))})

    return joined.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                    "base_score double, score double")
