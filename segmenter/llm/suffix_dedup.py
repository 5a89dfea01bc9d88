"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Sampling: a suffix array over every byte is not needed to find strings of at
least ``length`` bytes. Of the byte positions in a window of ``length`` bytes,
the one whose ``gram``-byte string has the smallest hash (the first of these) is
the window's anchor. Equal windows have equal anchors at equal places, so every
repeated window is found at its anchor. About one position in 150 is an anchor.

Suffix arrays: a record is an anchor's suffix: its first bytes (``lead``), the
fingerprint of its ``gram`` bytes, the fingerprint of all bytes that its windows
span (``ctx``), and the document and windows it stands for. A level is a table
of records, sorted by suffix inside hash partitions, on the shared checkpoint
folder (a suffix that very many documents share may span several of them).
Each new batch of documents gets a level; as long as the two newest
levels have the same size class they are merged into one of twice the size, so
there are logarithmically many levels and a record is rewritten logarithmically
often.

Scan: the levels are merged by suffix. A suffix met once repeats nothing. Where
two records agree in ``ctx`` too, all their windows are repeats. What is left
are suffixes whose surroundings differ, at the edges of repeated passages: there
the single windows are compared by their hashes, in blocks of documents. A block
sends each hash range its distinct window hashes once, marked if it holds them
twice, and gets back which of them are repeats; a window that a third of all
documents share is one entry a block.

Words: with ``words``, runs of so many words that occur elsewhere, whatever the
blanks between them, are removed too, found the same way over the sequence of a
text's word hashes. Their records (``unit`` 1, places in words) share the levels,
the blocks and the answers with those over bytes (``unit`` 0).

Windows never cross documents. Strings are compared by 64-bit hashes (records
by 192 bits).

Defined results: a null text is empty; texts shorter than ``length`` repeat
nothing; rows that repeat id and text are two documents; a null ``doc_id`` keeps
its row; an empty table gives no rows; extra columns are not read, except by
:func:`dedup_texts`, which keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

_STEP = 1 << 20
RECORD = "lead long, fp long, ctx long, dk long, th int, lo int, hi int, unit int"
# Words [^\x20\x09-\x0D]+ as they stand.
WORDS = (tk.SPACED[0], np.arange(256, dtype=np.uint8))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` values, from block minima on both sides."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).reshape(-1)
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def anchors(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Records of the texts in ``buf`` (bytes, or hashes of words): arrays (document,
    first window, last window, lead, fp, ctx); windows are places in their document.

    Buffers are walked in steps, so memory is bounded for any text length. A
    record whose windows a step divides becomes two; the scan allows for that.
    """
    w = length - gram + 1
    for s in range(0, max(len(buf) - length + 1, 0), _STEP):
        x = buf[s:s + _STEP + length - 1]
        n = len(x) - length + 1
        doc = np.searchsorted(off, np.arange(s, s + n), "right") - 1
        ok = np.arange(s, s + n) + length <= off[doc + 1]
        if not ok.any():
            continue
        sums, inv = tk.running_hash(x)
        h = tk.mix((sums[gram:] - sums[:-gram]) * inv[:len(x) - gram + 1])
        # Half hash, half place: the smallest is the first of the smallest hashes.
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        p = np.flatnonzero(ok)
        a, d = at[p], doc[p]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
        last = np.r_[first[1:], len(p)] - 1
        lo, hi, a, d = p[first], p[last], a[first], d[first]
        ctx = tk.mix((sums[hi + length] - sums[lo]) * inv[lo] + ((a - lo) * 4096 + hi - lo).astype(np.uint64))
        lead = np.zeros(len(a), np.uint64)
        for j in range(8):
            lead = (lead << np.uint64(8)) | x[a + j].astype(np.uint64)
        start = off[d] - s
        yield d, lo - start, hi - start, lead ^ np.uint64(1 << 63), h[a], ctx


def window_hashes(x: np.ndarray, lo: int, hi: int, length: int) -> np.ndarray:
    """Hashes of the windows that start at ``lo`` .. ``hi`` of a text."""
    part = x[lo:hi + length]
    sums, inv = tk.running_hash(part)
    return tk.mix((sums[length:] - sums[:-length]) * inv[:hi - lo + 1])


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the document key (dk, th): hashes of id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("dk", F.xxhash64(F.col("doc_id").cast("long"), text)).withColumn("th", F.hash(text))


class SuffixFamily:
    """Levels of sampled suffix arrays that grow batch by batch."""

    def __init__(self, length: int = 400, gram: int = 100, words: int = 0):
        if 0 < words < 16:
            raise ValueError("runs of 16 words or more can be looked for")
        self.length, self.gram, self.words = length, gram, words
        self.levels: list[tuple[int, DataFrame]] = []  # (size class, sorted records), oldest first

    def records(self, docs: DataFrame) -> DataFrame:
        length, gram, words = self.length, self.gram, self.words

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for part in tk.slices(batch, "text", 2 << 20):
                    buf, off = tk.text_buffer(part.column("text"))
                    dk, th = np.asarray(part.column("dk")), np.asarray(part.column("th"))
                    units = [(0, buf, off, length, gram)]
                    if words:
                        units.append((1, *tk.words_by_row(buf, off, WORDS)[:2], words, max(8, words // 4)))
                    for unit, x, rows, run_length, part_length in units:
                        for d, lo, hi, lead, fp, ctx in anchors(x, rows, run_length, part_length):
                            yield pa.RecordBatch.from_pydict({
                                "lead": pa.array(tk.signed(lead)), "fp": pa.array(tk.signed(fp)), "ctx": pa.array(tk.signed(ctx)),
                                "dk": pa.array(dk[d]), "th": pa.array(th[d]), "lo": pa.array(lo.astype(np.int32)),
                                "hi": pa.array(hi.astype(np.int32)), "unit": pa.array(np.full(len(d), unit, np.int32))})

        return docs.select("dk", "th", "text").mapInArrow(run, RECORD)

    def _sorted(self, records: DataFrame) -> DataFrame:
        # A rebalance may split the rows of a suffix that very many documents share.
        return tk.cut_lineage(records.hint("rebalance", "lead", "fp").sortWithinPartitions("lead", "fp", "ctx"), "suffixes")

    def add(self, batch: DataFrame) -> None:
        """Indexes a batch of keyed documents; equal-sized levels merge."""
        self.levels.append((0, self._sorted(self.records(batch))))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, new), (_, old) = self.levels.pop(), self.levels.pop()
            self.levels.append((size + 1, self._sorted(old.unionByName(new))))
            tk.discard(old)
            tk.discard(new)

    def scan(self) -> DataFrame:
        """(dk, th, lo, hi, kind, unit) of all repeated suffixes. Kind 0: all windows
        repeat; 1: single windows may; 2: as 0, and this record stands for its
        likes when single windows are compared."""
        every = self.levels[0][1]
        for _, level in self.levels[1:]:
            every = every.unionByName(level)
        same = every.groupBy("lead", "fp", "ctx").agg(F.count(F.lit(1)).alias("n"),
                                                      F.min(F.struct("dk", "th", "lo")).alias("rep"))
        suffix = same.groupBy("lead", "fp").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1")
        met = same.join(suffix, ["lead", "fp"]).select("lead", "fp", "ctx", "n", "rep", "kinds")
        kind = (F.when(F.col("n") == 1, 1).when((F.col("kinds") > 1) & (F.struct("dk", "th", "lo") == F.col("rep")), 2)
                .otherwise(0))
        return every.join(met, ["lead", "fp", "ctx"]).select("dk", "th", "lo", "hi", kind.alias("kind"), "unit")


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open spans; touching spans are one run."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]]


def _to_bytes(x: np.ndarray, spans: list[dict], length: int, words: int):
    """A function from (first window, last window, unit) of a text to its bytes, from and to."""
    first, last = tk.spans(WORDS[0][x]) if any(s["unit"] for s in spans) else (None, None)
    return lambda lo, hi, unit: (first[lo], last[hi + words - 1]) if unit else (lo, hi + length)


def _block_windows(row: dict, length: int, words: int):
    """Window hashes of a block's kinds 1 and 2, with document and the bytes from and to."""
    h, doc, start, end, test = [], [], [], [], []
    for i, (text, spans) in enumerate(zip(row["texts"], row["spans"], strict=True)):
        x = np.frombuffer(text.encode(), np.uint8)
        to_bytes, of_words = _to_bytes(x, spans, length, words), None
        for s in spans:
            if s["kind"] > 0:
                if s["unit"] and of_words is None:
                    of_words = tk.words(x, WORDS)[0]
                one = window_hashes(of_words, s["lo"], s["hi"], words) if s["unit"] else window_hashes(x, s["lo"], s["hi"], length)
                at = np.arange(s["lo"], s["hi"] + 1)
                lo, hi = to_bytes(at, at, s["unit"])
                h.append(one)
                doc.append(np.full(len(one), i))
                start.append(lo)
                end.append(hi)
                test.append(np.full(len(one), s["kind"] == 1))

    def join(xs, kind):
        return np.concatenate(xs) if xs else np.empty(0, kind)

    return join(h, np.uint64), join(doc, np.int64), join(start, np.int64), join(end, np.int64), join(test, bool)


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 100, batches: int = 3,
                   block_bytes: int = 8 << 20, keys_per_range: int = 2_000_000, words: int = 0) -> DataFrame:
    """(dk, th, starts, ends, n_bytes, kept_sha256, kept) of every document that
    holds repeated bytes, or with ``words`` repeated runs of so many words: the maximal
    runs to remove, in bytes, and what stays.

    ``docs`` is keyed. It is indexed in ``batches`` batches by document key.
    """
    spark = docs.sparkSession
    src = docs.select("dk", "th", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    family = SuffixFamily(length, gram, words)
    for b in range(batches):
        family.add(src.where(F.pmod("dk", F.lit(batches)) == b))
    found = family.scan().groupBy("dk", "th").agg(F.collect_set(F.struct("lo", "hi", "kind", "unit")).alias("spans"))
    found = tk.cut_lineage(found, "found")
    for _, level in family.levels:
        tk.discard(level)
    bits = spark.sparkContext.broadcast(tk.id_filter(found.select(F.col("dk").alias("h"))))

    def wanted(rows):
        import pyarrow as pa

        for batch in rows:
            yield batch.filter(pa.array(tk.in_filter(bits.value, batch.column("slot")))).drop_columns(["slot"])

    texts = (src.withColumn("slot", tk.slot(F.col("dk"))).mapInArrow(wanted, "dk long, th int, text string")
             .join(found, ["dk", "th"]).groupBy("dk", "th").agg(F.first("text").alias("text"), F.first("spans").alias("spans")))

    def pack(rows):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.int32()), ("unit", pa.int32())]))

        def row(parts):
            cols = {c: pa.concat_arrays([p.column(c) for p in parts]) for c in ("dk", "th", "text", "spans")}
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(t))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([0], pa.int64()), "dks": one(cols["dk"], pa.int64()), "ths": one(cols["th"], pa.int32()),
                "texts": one(cols["text"], pa.string()), "spans": one(cols["spans"], kind)})

        held, size = [], 0
        for batch in rows:
            for part in tk.slices(batch, "text", 2 << 20):
                held.append(part)
                size += tk.text_buffer(part.column("text"))[1][-1]
                if size >= block_bytes:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    blocks = texts.mapInArrow(pack, "block long, dks array<long>, ths array<int>, texts array<string>, "
                                    "spans array<array<struct<lo:int,hi:int,kind:int,unit:int>>>")
    blocks = tk.cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    n_keys = found.select(F.explode("spans").alias("s")).where("s.kind > 0").agg(F.sum(F.expr("s.hi - s.lo + 1"))).head()[0] or 0
    ranges = max(1, -(-n_keys // keys_per_range))

    def deal(rows):
        import pyarrow as pa

        for batch in rows:
            for row in tk.rows(batch):
                keys, n = np.unique(_block_windows(row, length, words)[0], return_counts=True)
                cut = _ranges(keys, ranges)
                full = [i for i in range(ranges) if cut[i + 1] > cut[i]]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(full, pa.int32()), "block": pa.array([row["block"]] * len(full), pa.int64()),
                    "keys": pa.array([keys[cut[i]:cut[i + 1]].tobytes() for i in full], pa.binary()),
                    "twice": pa.array([np.packbits(n[cut[i]:cut[i + 1]] > 1).tobytes() for i in full], pa.binary())})

    def answer(pdf):
        keys = [np.frombuffer(k, np.uint64) for k in pdf["keys"]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8))[:len(k)] for t, k in zip(pdf["twice"], keys, strict=True)])
        lens = np.cumsum([len(k) for k in keys])
        k = np.concatenate(keys)
        order = np.argsort(k, kind="stable")
        s = k[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        group = np.empty(len(s), np.int64)
        group[order] = np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1
        seen = np.diff(np.r_[first, len(s)]) + np.bincount(group, weights=twice, minlength=len(first))
        flag = (seen > 1)[group]
        pdf = pdf[["block", "part"]].copy()
        pdf["repeats"] = [np.packbits(x).tobytes() for x in np.split(flag, lens[:-1])]
        return pdf

    answers = (blocks.select("block", "texts", "spans").mapInArrow(deal, "part int, block long, keys binary, twice binary")
               .groupBy("part").applyInPandas(answer, "block long, part int, repeats binary")
               .groupBy("block").agg(F.collect_list(F.struct("part", "repeats")).alias("answers")))

    def finish(rows):
        import pyarrow as pa

        for batch in rows:
            for row in tk.rows(batch):
                h, doc, start, end, test = _block_windows(row, length, words)
                keys, back = np.unique(h, return_inverse=True)
                cut = _ranges(keys, ranges)
                flag = np.zeros(len(keys), bool)
                for a in row["answers"] or []:
                    lo, hi = cut[a["part"]], cut[a["part"] + 1]
                    flag[lo:hi] = np.unpackbits(np.frombuffer(a["repeats"], np.uint8))[:hi - lo]
                hit = flag[back] & test
                doc, start, end = doc[hit], start[hit], end[hit]
                edge = np.searchsorted(doc, np.arange(len(row["dks"]) + 1))
                out = {"dk": row["dks"], "th": row["ths"], "starts": [], "ends": [], "n_bytes": [], "kept_sha256": [], "kept": []}
                for i, (text, spans) in enumerate(zip(row["texts"], row["spans"], strict=True)):
                    raw = text.encode()
                    to_bytes = _to_bytes(np.frombuffer(raw, np.uint8), spans, length, words)
                    whole = np.array([to_bytes(s["lo"], s["hi"], s["unit"]) for s in spans if s["kind"] != 1], np.int64).reshape(-1, 2)
                    single = slice(edge[i], edge[i + 1])
                    lo, hi = _merge(np.r_[whole[:, 0], start[single]], np.r_[whole[:, 1], end[single]])
                    keep = b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))
                    out["starts"].append(lo)
                    out["ends"].append(hi)
                    out["n_bytes"].append(len(raw))
                    out["kept_sha256"].append(hashlib.sha256(keep).hexdigest())
                    out["kept"].append(keep)
                yield pa.RecordBatch.from_pydict({
                    "dk": pa.array(out["dk"], pa.int64()), "th": pa.array(out["th"], pa.int32()),
                    "starts": pa.array(out["starts"], pa.list_(pa.int64())), "ends": pa.array(out["ends"], pa.list_(pa.int64())),
                    "n_bytes": pa.array(out["n_bytes"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                    "kept": pa.array(out["kept"], pa.binary())})

    done = blocks.join(answers, "block", "left").mapInArrow(
        finish, "dk long, th int, starts array<long>, ends array<long>, n_bytes long, kept_sha256 string, kept binary")
    return done.where(F.size("starts") > 0)


def dedup_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    src = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    cut = repeated_spans(src, length).select(
        "dk", "th", F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x).alias("r"),
        F.size("starts").cast("long").alias("s"), F.col("kept_sha256").alias("k"))
    text = F.coalesce("text", F.lit(""))
    light = src.select("doc_id", "dk", "th", F.octet_length(text).cast("long").alias("n_bytes"),
                       F.sha2(text.cast("binary"), 256).alias("whole"))
    return light.join(cut, ["dk", "th"], "left").select(
        "doc_id", "n_bytes", F.coalesce("r", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("s", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("k", "whole").alias("kept_sha256"))


def dedup_texts(docs: DataFrame, length: int = 400, words: int = 0) -> DataFrame:
    """``docs`` with repeated strings, and with ``words`` repeated runs of so many
    words, cut out of ``text``; a character that a cut divides goes too. All columns
    and rows stay."""
    # All columns travel in one, so none of their names can clash.
    src = keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    cut = repeated_spans(src, length, words=words).select("dk", "th", "kept")

    def valid(batches):
        import pyarrow as pa

        for batch in batches:
            new = [k.decode("utf-8", "ignore") for k in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_pydict({"dk": batch.column("dk"), "th": batch.column("th"), "_new": pa.array(new, pa.string())})

    new = cut.mapInArrow(valid, "dk long, th int, _new string")
    names = [(F.coalesce("_new", "text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return src.join(new, ["dk", "th"], "left").select(*names)
