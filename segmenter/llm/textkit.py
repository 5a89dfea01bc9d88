"""Shared helpers for the corpus operators: vectorised word hashing over UTF-8
bytes, Arrow batch slicing, lineage cuts and distributed connected components.

Words are found on bytes: a byte table says which bytes belong to a word, runs
of such bytes are words, and every word gets the 64-bit polynomial hash of its
bytes, computed for a whole buffer at once from a running sum (arithmetic
modulo 2**64). A buffer is walked in pieces of at most ``PIECE`` bytes that end
between two words, so memory stays bounded for any text length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_lineage_observed, discard, scratch_path  # noqa: F401  (re-exported)

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_POW = _INV = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    global _POW, _INV
    if _POW is None or len(_POW) < n:
        size = max(n, PIECE + 4096)

        def table(b: int) -> np.ndarray:
            t = np.full(size, b & (2**64 - 1), _U)
            t[0] = 1
            return np.cumprod(t, dtype=_U)

        _POW, _INV = table(_BASE), table(pow(_BASE, -1, 1 << 64))
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixer: spreads a 64-bit hash over all bits (bijective)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def byte_table(is_word: list[int] | np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word flags, lower-casing table) for :func:`words`."""
    flags = np.zeros(256, bool)
    flags[np.asarray(is_word)] = True
    low = np.arange(256, dtype=np.uint8)
    if lower:
        low[65:91] += 32
    return flags, low


# Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters, non-ASCII bytes.
ALNUM = byte_table(np.r_[48:58, 65:91, 97:123, 128:256])
# Words [^\x20\x09-\x0D]+ after lower-casing A-Z: all but ASCII white space.
SPACED = byte_table(np.setdiff1d(np.arange(256), np.r_[9:14, 32]))


def running_hash(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers from which the hash of any byte range
    ``[a, b)`` is ``(sums[b] - sums[a]) * inv[a]``."""
    pw, inv = _powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, _U)
    np.cumsum((x.astype(_U) + _U(1)) * pw[:len(x)], out=sums[1:])
    return sums, inv


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].view(np.int8)))
    return edge[0::2], edge[1::2]


def _long_word(piece: np.ndarray) -> np.ndarray:
    """Hash of one word longer than a piece, folded over its parts."""
    h = _U(len(piece))
    for i in range(0, len(piece), PIECE):
        sums, inv = running_hash(piece[i:i + PIECE])
        h = mix(np.array([h * _U(31) + (sums[-1] - sums[0])], _U))[0]
    return np.array([h], _U)


def words(buf: np.ndarray, table: tuple[np.ndarray, np.ndarray], prefixes: tuple[int, ...] = ()
          ) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes and byte starts of the words of ``buf`` (uint8), and for each
    length in ``prefixes`` the hashes of the words' first so many bytes
    (0 for shorter words)."""
    flags, low = table
    hs, starts, pre = [], [], [[] for _ in prefixes]
    at, n = 0, len(buf)
    while at < n:
        end = min(n, at + PIECE)
        if end < n and flags[buf[end]]:
            # Move the cut back to a non-word byte, or forward over one huge word.
            back = np.flatnonzero(~flags[buf[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                while end < n:
                    stop = np.flatnonzero(~flags[buf[end:end + PIECE]])
                    if len(stop):
                        end += int(stop[0])
                        break
                    end = min(n, end + PIECE)
        piece = low[buf[at:end]]
        if end - at > PIECE:
            # A single word longer than a piece (then the piece is that word).
            hs.append(_long_word(piece))
            starts.append(np.array([at]))
            for p, ell in zip(pre, prefixes, strict=True):
                p.append(_long_word(piece[:ell]))
            at = end
            continue
        s, e = spans(flags[piece])
        if len(s):
            sums, inv = running_hash(piece)
            hs.append(mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(_U)))
            starts.append(s + at)
            for p, ell in zip(pre, prefixes, strict=True):
                cut = np.minimum(e, s + ell)
                h = mix((sums[cut] - sums[s]) * inv[s] + _U(1000 + ell))
                h[e - s < ell] = 0
                p.append(h)
        at = end

    def join(xs: list[np.ndarray], kind: type) -> np.ndarray:
        return np.concatenate(xs) if xs else np.empty(0, kind)

    return join(hs, _U), join(starts, np.int64), [join(p, _U) for p in pre]


def hash_word(word: str, prefix: int | None = None) -> int:
    """The hash that :func:`words` gives to this word (or to this prefix)."""
    b = np.frombuffer(word.encode(), np.uint8)
    sums, inv = running_hash(b)
    h = (sums[len(b)] - sums[0]) * inv[0]
    return int(mix(np.array([h + _U(len(b) if prefix is None else 1000 + prefix)], _U))[0])


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; null is empty."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = pa.large_binary()
    col = col.cast(pa.large_string() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else kind)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if not len(off):
        off = np.zeros(1, np.int64)
    return buf[off[0]:off[-1]], off - off[0]


def slices(batch, column: str, limit: int) -> Iterator:
    """Zero-copy slices of an Arrow batch with about ``limit`` text bytes each
    (a longer single row is a slice of its own)."""
    if not batch.num_rows:
        return
    _, off = text_buffer(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(batch.num_rows, max(hi, lo + 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def rows(batch) -> Iterator[dict]:
    """The rows of an Arrow batch as dicts, one at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def words_by_row(buf: np.ndarray, off: np.ndarray, table, prefixes: tuple[int, ...] = ()
                 ) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word hashes of a column of texts; words never join two texts. Returns
    (hashes, row offsets into them, prefix hashes)."""
    # A separator byte after every text keeps words of neighbours apart.
    n = len(off) - 1
    sep = 32
    out = np.full(len(buf) + n, sep, np.uint8)
    lens = np.diff(off)
    row = np.repeat(np.arange(n), lens)
    out[np.arange(len(buf)) + row] = buf
    h, s, pre = words(out, table, prefixes)
    return h, np.searchsorted(s, off + np.arange(n + 1)), pre


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, whatever else is there."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo ``mod`` (-1 for a null id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod, F.lit(-1).cast("long"))


FILTER_BITS = 26


def slot(h: Column) -> Column:
    """Place of a 64-bit hash in an id filter."""
    return F.pmod(h, F.lit(1 << FILTER_BITS))


def id_filter(hashes: DataFrame) -> np.ndarray:
    """Bit filter (8 MB, whatever the number of hashes) of a column ``h``: a
    task that knows it passes over most rows that a join would drop later."""
    at = f"pmod(h, {1 << FILTER_BITS}) + 1"
    rows = (hashes.groupBy(F.expr(f"bitmap_bucket_number({at})").alias("b"))
            .agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({at}))").alias("m")).collect())
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows:  # a bucket holds 2**15 bits
        first = (r["b"] - 1) << 12
        out[first:first + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def in_filter(bits: np.ndarray, slots) -> np.ndarray:
    at = np.asarray(slots)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): component is the
    smallest id reachable, itself included.

    Alternating large-star and small-star steps: every round is two grouped
    aggregations with partial minima, and the edge list is written to the
    shared checkpoint folder after each round. Rounds grow with the logarithm
    of the path length, so nothing is gathered on the driver. A large star is
    never collected: minima are joined back to the edges.
    """
    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        df, seen = cut_lineage_observed(df, "cc", F.count(F.lit(1)).alias("n"),
                                        F.bit_xor(F.xxhash64("u", "v")).alias("x"))
        return df, (seen["n"], seen["x"])

    e, state = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .where("u is not null and v is not null").distinct())
    for _ in range(max_rounds):
        # Large star: link each larger neighbour to the smallest neighbour.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: link the smaller neighbours and the node to their minimum.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        before = state
        e, state = written(small)
        if state == before:  # nothing moved: every node points at its root
            roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
