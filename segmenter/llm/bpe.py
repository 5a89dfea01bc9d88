"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Every chunk is split into pre-tokens by
itself, starting cold at its first character, on whichever executor it lands.
The first pre-token boundaries of a chunk may be wrong, as may the last ones,
but boundaries only depend on what follows them: as soon as a boundary of a
chunk equals a trusted boundary of the chunk before, all later ones agree. At
that point the two are stitched, the pieces between the stitches are encoded
side by side, and a document's ids are put together again in chunk order.
Where two chunks have no common boundary in their overlap (a pre-token longer
than the overlap), the pair is joined and split again as one.

Decoding looks every id up and concatenates the raw bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; null
and repeated ``doc_id`` keep their rows; an empty table gives no rows; extra
columns are not read. Any special-token text is ordinary text.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

_LOADED: dict[tuple, tuple] = {}


def load(path: str, pattern: str):
    """(tiktoken encoding, compiled pattern) of a rank file, once a process."""
    if (path, pattern) not in _LOADED:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = (tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}),
                                  regex.compile(pattern))
    return _LOADED[path, pattern]


def boundaries(pattern, text: str, last: bool) -> list[int]:
    """Ends of the pre-tokens of ``text`` at which it may be cut: the character
    before is no white space, so that the pre-token does not depend on what
    follows. The match that touches the end counts only if the whole text ends
    there (``last``)."""
    out = []
    for m in pattern.finditer(text):
        e = m.end()
        if not text[e - 1].isspace() and (last or e < len(text)):
            out.append(e)
    return out


def encode_ids(encoding, text: str) -> np.ndarray:
    """Ids of a text; nothing in it is a special token."""
    return encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def decode_ids(table: list[bytes], ids: np.ndarray) -> bytes:
    """Raw bytes of ids, concatenated; they need not be valid UTF-8."""
    return b"".join(map(table.__getitem__, ids.tolist()))


def byte_table(encoding) -> list[bytes]:
    return [encoding.decode_single_token_bytes(i) for i in range(encoding.n_vocab)]


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _hash_whole(path: str, pattern: str, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        encoding, _ = load(path, pattern)
        table = byte_table(encoding)
        for batch in batches:
            for part in tk.slices(batch, "text", 8 << 20):
                n, a, b, raw = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = encode_ids(encoding, text or "")
                    n.append(len(ids))
                    raw.append(ids.tobytes())
                    a.append(hashlib.sha256(raw[-1]).hexdigest())
                    b.append(hashlib.sha256(decode_ids(table, ids)).hexdigest())
                cols = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                        "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
                if with_ids:
                    cols["ids"] = pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _split_chunks(path: str, pattern: str, chunk: int, overlap: int):
    """Adds ``head`` (boundaries in the chunk's first ``overlap`` characters)
    and ``tail`` (those in the overlap with the next chunk, counted from the
    next chunk's start)."""

    def run(batches):
        import pyarrow as pa

        _, rx = load(path, pattern)
        for batch in batches:
            for part in tk.slices(batch, "piece", 8 << 20):
                head, tail = [], []
                last = np.asarray(part.column("part")) + 1 == np.asarray(part.column("parts"))
                for text, end in zip(part.column("piece").to_pylist(), last.tolist(), strict=True):
                    at = np.asarray(boundaries(rx, text, end), np.int32)
                    head.append(at[at < overlap])
                    tail.append(at[at >= chunk] - np.int32(chunk))
                names = ("row", "doc_id", "part", "parts", "piece")
                cols = {c: part.column(c) for c in names}
                cols["head"] = pa.array(head, pa.list_(pa.int32()))
                cols["tail"] = pa.array(tail, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _encode_pieces(path: str, pattern: str):
    def run(batches):
        import pyarrow as pa

        encoding, _ = load(path, pattern)
        for batch in batches:
            for part in tk.slices(batch, "text", 8 << 20):
                ids = [encode_ids(encoding, t).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("row", "doc_id", "part")}
                                                 | {"ids": pa.array(ids, pa.binary())})

    return run


def _hash_parts(path: str, pattern: str, with_ids: bool):
    """Digests of documents whose parts arrive in order, one part at a time."""

    def run(batches):
        import pyarrow as pa

        encoding, _ = load(path, pattern)
        table = byte_table(encoding)
        row, state = None, None

        def result():
            cols = {"doc_id": pa.array([state[0]], pa.int64()), "n_tokens": pa.array([state[1]], pa.int64()),
                    "ids_sha256": pa.array([state[2].hexdigest()]), "decoded_sha256": pa.array([state[3].hexdigest()])}
            if with_ids:
                cols["ids"] = pa.array([b"".join(state[4])], pa.binary())
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            for r, d, raw in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(),
                                 batch.column("ids"), strict=True):
                if r != row:
                    if state is not None:
                        yield result()
                    row, state = r, [d, 0, hashlib.sha256(), hashlib.sha256(), []]
                raw = raw.as_py()
                ids = np.frombuffer(raw, "<u4")
                state[1] += len(ids)
                state[2].update(raw)
                state[3].update(decode_ids(table, ids))
                if with_ids:
                    state[4].append(raw)
        if state is not None:
            yield result()

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = 16_384, overlap: int = 1_024,
                     with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, and
    with ``with_ids`` its ids as little-endian unsigned 32-bit integers.

    A text of at most ``chunk`` characters is one chunk and needs no stitching.
    The chunks of longer texts are dealt over all tasks.
    """
    if overlap >= chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    schema = _RESULT + (", ids binary" if with_ids else "")
    src = tk.documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    n_chars = F.length("text")
    short = src.where(n_chars <= chunk).mapInArrow(_hash_whole(path, pattern, with_ids), schema)
    parts = F.ceil(n_chars / chunk).cast("int")
    chunks = (src.where(n_chars > chunk)
              .select(F.monotonically_increasing_id().alias("row"), "doc_id", parts.alias("parts"), "text")
              .select("row", "doc_id", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")
              .select("row", "doc_id", "part", "parts",
                      F.substring("text", F.col("part") * chunk + 1, F.lit(chunk + overlap)).alias("piece"))
              .repartition("row", "part"))
    split = tk.cut_lineage(chunks.mapInArrow(
        _split_chunks(path, pattern, chunk, overlap),
        "row long, doc_id long, part int, parts int, piece string, head array<int>, tail array<int>"), "chunks")
    w = Window.partitionBy("row").orderBy("part")
    # The first boundary on which a chunk and the one before agree; part 0 starts at 0.
    met = (split.select("row", "part", "head", F.lag("tail").over(w).alias("before"))
           .select("row", "part", F.when(F.col("part") == 0, F.lit(0))
                   .otherwise(F.array_min(F.array_intersect("head", "before"))).alias("start")))
    stitched = met.select("row", "part", "start", F.lead("start").over(w).alias("next"),
                          F.max(F.col("start").isNull()).over(Window.partitionBy("row")).alias("torn"))
    pieces = split.drop("head", "tail").join(stitched, ["row", "part"])
    cut = pieces.where("not torn").select(
        "row", "doc_id", "part",
        F.expr(f"substring(piece, start + 1, coalesce({chunk} + next, length(piece)) - start)").alias("text"))
    # No common boundary somewhere: those texts are joined and encoded as one piece.
    torn = (pieces.where("torn").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.struct("part", F.expr(f"substring(piece, 1, {chunk})").alias("t")))).alias("c"))
        .select("row", "doc_id", F.lit(0).alias("part"), F.concat_ws("", F.col("c.t")).alias("text")))
    long = (cut.union(torn).mapInArrow(_encode_pieces(path, pattern), "row long, doc_id long, part int, ids binary")
            .repartition("row").sortWithinPartitions("row", "part").mapInArrow(_hash_parts(path, pattern, with_ids), schema))
    return short.union(long)
