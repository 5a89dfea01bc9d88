"""Token ids in binary files: fixed-width bit packing with block offsets.

File format (little-endian), one file per run of documents:

=================  ===========================================================
``TPK1``           4 bytes
header             version u16, bits u16, vocabulary u32, ids per block u32,
                   reserved u32, documents u64, ids u64, blocks u64
doc_id             int64 per document; 0 where there is none
has_id             u8 per document
doc_start          u64 per document and one more: first id, within the file
block_offset       u64 per block and one more: byte offsets from the payload
payload            blocks of bit-packed ids, each a whole number of 64-bit words
=================  ===========================================================

Ids take the fewest bits that hold the vocabulary. Sixty-four ids of b bits are
exactly b 64-bit words, so packing and unpacking are 64 numpy shifts over all
groups at once, and id i lies in block i // ids-per-block: any range is read by
its block offsets alone.

Writing: documents are range-partitioned and sorted by id, and every task
writes files in that order under names of its own. The manifest (one row per
file, a table that Spark commits) names the files of the attempts that count
and gives the global position of each file's first id, a distributed prefix
sum; files of other attempts are never read.

Tokenising: a column of texts is cut at ASCII blanks and line ends and before
closing punctuation, where no token can continue, and its pieces become an Arrow
dictionary. Each distinct piece is looked up once a column, encoded once by the
tokenizers library and kept in a table of bounded size, which serves all tasks
of a Python worker.
Strings of special tokens get those tokens' ids, as the library does by default;
``special_as_text`` makes them ordinary text.

Defined results: a null or empty text holds only the end id; a null ``doc_id``
sorts first; repeated ids keep all rows, ordered by text hash; an empty table
gives no files and no rows; extra columns are not read. A very long text is
tokenised in its task at once, so its size must fit there; ids are 4 bytes each.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import partition_offsets
from ..session import partitions_for
from . import textkit as tk

MAGIC = b"TPK1"
HEADER = struct.Struct("<4sHHIIIQQQ")
MANIFEST = "path string, pid int, seq int, n_docs long, n_ids long"


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit-packed ids, padded with zeros to a multiple of 64 ids."""
    groups = -(-len(ids) // 64)
    x = np.zeros(groups * 64, np.uint64)
    x[:len(ids)] = ids
    x = np.ascontiguousarray(x.reshape(groups, 64).T)
    out = np.zeros((bits, groups), np.uint64)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        out[w] |= x[j] << np.uint64(s)
        if s + bits > 64:
            out[w + 1] |= x[j] >> np.uint64(64 - s)
    return np.ascontiguousarray(out.T).astype("<u8", copy=False).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed ``data`` as unsigned 32-bit integers."""
    words = np.frombuffer(data, "<u8")
    groups = len(words) // bits
    x = np.ascontiguousarray(words.reshape(groups, bits).T)
    out = np.empty((64, groups), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        v = x[w] >> np.uint64(s)
        if s + bits > 64:
            v = v | (x[w + 1] << np.uint64(64 - s))
        out[j] = v & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def file_bytes(doc_ids: list, lens: list[int], ids: np.ndarray, bits: int, vocabulary: int, block: int) -> list[bytes]:
    """The parts of a file, in order."""
    blocks = [pack(ids[i:i + block], bits) for i in range(0, len(ids), block)]
    return [HEADER.pack(MAGIC, 1, bits, vocabulary, block, 0, len(doc_ids), len(ids), len(blocks)),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], "u1").tobytes(),
            np.r_[0, np.cumsum(lens)].astype("<u8").tobytes(),
            np.r_[0, np.cumsum([len(b) for b in blocks])].astype("<u8").tobytes(), *blocks]


class TokenFile:
    """Random access to one file through an object with ``seek`` and ``read``."""

    def __init__(self, handle):
        self.handle = handle
        handle.seek(0)
        (magic, version, self.bits, self.vocabulary, self.block, _, n_docs, self.n_ids, n_blocks
         ) = HEADER.unpack(handle.read(HEADER.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        read = lambda kind, n: np.frombuffer(handle.read(np.dtype(kind).itemsize * n), kind)
        self.doc_ids, self.has_id = read("<i8", n_docs), read("u1", n_docs).astype(bool)
        self.doc_start = read("<u8", n_docs + 1).astype(np.int64)
        self.block_offset = read("<u8", n_blocks + 1).astype(np.int64)
        self.payload = handle.tell()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive): only their blocks are read."""
        if end <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-end // self.block)
        self.handle.seek(self.payload + int(self.block_offset[a]))
        data = self.handle.read(int(self.block_offset[b] - self.block_offset[a]))
        if self.block % 64 == 0:  # blocks are whole groups, so all of them unpack at once
            got = unpack(data, self.bits, min(b * self.block, self.n_ids) - a * self.block)
        else:
            got = np.concatenate([
                unpack(data[int(self.block_offset[k] - self.block_offset[a]):int(self.block_offset[k + 1] - self.block_offset[a])],
                       self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(a, b)])
        return got[start - a * self.block:end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.doc_start[i]), int(self.doc_start[i + 1]))


def open_store(uri: str):
    """(file system, path) of a folder named by the session's checkpoint setting."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class PieceEncoder:
    """Encodes texts with a tokenizer whose tokens never cross blanks, through a
    table of at most about ``limit`` strings. A full table keeps the strings that
    were met several times since the last time it was full. Strings of special
    tokens get their own ids, as the library gives them, unless ``special_as_text``."""

    def __init__(self, path: str, limit: int = 600_000, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        # Only strings with one of these characters can hold a special token, whose case counts.
        self.marks = {t.content[0] for t in self.tok.get_added_tokens_decoder().values()}
        self.limit = limit
        # String -> its number; the ids of string k are flat[ends[k]:ends[k + 1]].
        self.pieces, self.flat, self.ends = {}, array("i"), array("q", [0])
        self.hits = np.zeros(0, np.int32)

    def _lower(self, x: str) -> str:
        """Lower case for ASCII, as the tokenizer does, so that spellings share an entry."""
        return x.lower() if x.isascii() and self.marks.isdisjoint(x) else x

    def split(self, piece: str) -> tuple[str, ...]:
        """A piece without its closing ASCII punctuation, and that punctuation:
        the tokenizer's pattern always cuts between a letter or digit and a
        punctuation mark. The letter must stay one when it is lower-cased
        (U+0130 becomes two characters, the second no letter)."""
        body = piece.rstrip(".,;:!?")
        if body and len(body) < len(piece) and body[-1].isalnum() and len(body[-1].lower()) == 1:
            return (self._lower(body), piece[len(body):])
        return (self._lower(piece),)

    def cut(self, col) -> tuple:
        """(pieces of the texts of an Arrow column, number of pieces of each): cut at
        blanks, and before closing punctuation after an ASCII letter or digit."""
        import pyarrow as pa

        buf, off = tk.text_buffer(col)
        kind = _KIND[buf]
        word = kind > 0
        first = word.copy()  # starts of pieces
        first[1:] &= ~word[:-1]
        heads = off[:-1][off[:-1] < off[1:]]
        first[heads] = word[heads]
        starts = np.flatnonzero(first)
        # Of each piece, the last byte that is no closing punctuation.
        inner = np.flatnonzero(kind > 1)
        upto = np.cumsum(kind > 1)[np.r_[starts[1:], len(buf)][:len(starts)] - 1]
        at = inner[np.maximum(upto - 1, 0)] if len(inner) else starts
        more = at[(at >= starts) & (kind[at] == 3)] + 1
        more = more[more < len(buf)]
        first[more[kind[more] == 1]] = True
        # A cut at a text's start is there already, so none joins two texts.
        starts = np.flatnonzero(first)
        ends = np.cumsum(word)
        at = np.r_[ends[starts] - 1, ends[-1] if len(ends) else 0].astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(buf[word]))
        return pieces, np.diff(np.searchsorted(starts, off))

    def _fold(self, words):
        """Distinct pieces, ASCII ones in lower case (see ``_lower``)."""
        import pyarrow.compute as pc

        plain = pc.string_is_ascii(words)
        for mark in self.marks:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, mark)))
        return pc.if_else(plain, pc.ascii_lower(words), words)

    def _add(self, x: str, ids) -> None:
        self.pieces[x] = len(self.ends) - 1
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def _learn(self, new: list[str]) -> None:
        pieces = self.pieces
        # An ASCII lower-case word is its own byte-level form and a single pre-token.
        tokenize, other, several = self.tok.model.tokenize, [], []
        for w in new:
            if w.isalpha() and w.isascii() and w.islower():
                self._add(w, [t.id for t in tokenize(w)])
            elif w[-1] in ".,;:!?":
                several.append((w, self.split(w)))
            else:
                other.append(w)
        other += {x for _, xs in several for x in xs if x not in pieces}.difference(other)
        for w, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self._add(w, e.ids)
        flat, ends = self.flat, self.ends
        for w, xs in several:
            if w not in pieces:
                ids = array("i")
                for x in xs:
                    k = pieces[x]
                    ids += flat[ends[k]:ends[k + 1]]
                self._add(w, ids)

    def _shrink(self, keep: set[str]) -> None:
        """Keeps the strings of ``keep`` that are known and those with several
        hits, or the former alone if the latter would fill half the table."""
        hits = np.r_[self.hits, np.zeros(len(self.ends) - 1 - len(self.hits), np.int32)] > 1
        often = int(hits.sum()) <= self.limit // 2
        kept = [(p, k) for p, k in self.pieces.items() if (often and hits[k]) or p in keep]
        flat, ends = self.flat, self.ends
        self.pieces, self.flat, self.ends = {}, array("i"), array("q", [0])
        for p, k in kept:
            self._add(p, flat[ends[k]:ends[k + 1]])
        self.hits = np.zeros(0, np.int32)

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, list[int]]:
        """(ids of all texts, each closed by ``end_id``; number of ids of each) of
        a list or an Arrow column. Each distinct piece is looked up once."""
        import pyarrow as pa

        col = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        words, count = self.cut(col)
        words = words.dictionary_encode()
        folded = self._fold(words.dictionary).dictionary_encode()
        seen = folded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in seen if p not in self.pieces]
        if len(self.pieces) + len(new) > self.limit:
            self._shrink(set(seen))
            new = [p for p in seen if p not in self.pieces]
        self._learn(new)
        flat, ends = np.array(self.flat, np.int32), np.array(self.ends, np.int64)
        slot = np.fromiter(map(self.pieces.__getitem__, seen), np.int64, len(seen))
        at = np.asarray(folded.indices)[np.asarray(words.indices)]
        hits = np.r_[self.hits, np.zeros(len(ends) - 1 - len(self.hits), np.int32)]
        hits[slot] += np.bincount(at, minlength=len(seen)).astype(np.int32)
        self.hits = hits
        # The end id is a piece of each text, behind its others.
        close = np.cumsum(count + 1) - 1
        body = np.ones(len(at) + len(col), bool)
        body[close] = False
        begin, n = np.zeros(len(body), np.int64), np.ones(len(body), np.int64)
        begin[body], n[body] = ends[slot][at], np.diff(ends)[slot][at]
        stop = np.cumsum(n)
        ids = np.arange(int(stop[-1]) if len(stop) else 0)
        ids += np.repeat(begin - stop + n, n)
        ids = flat[ids] if len(flat) else np.empty(len(ids), np.int32)
        ids[stop[close] - 1] = end_id
        return ids, np.diff(np.r_[0, stop[close]]).tolist()


# Kinds of bytes: 0 blanks and line ends, 1 closing punctuation, 3 ASCII letters and digits, 2 others.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 13, 32]] = 0
_KIND[list(b".,;:!?")] = 1
_KIND[np.r_[48:58, 65:91, 97:123]] = 3


@lru_cache(maxsize=1)
def worker_encoder(path: str, special_as_text: bool) -> PieceEncoder:
    """One encoder for all tasks that a Python worker runs."""
    return PieceEncoder(path, special_as_text=special_as_text)


def write_tokens(docs: DataFrame, path: str, folder: str, vocabulary: int, end_id: int = 1,
                 block: int = 4096, file_ids: int = 4 << 20, special_as_text: bool = False) -> DataFrame:
    """Encodes ``docs`` and writes token files to ``folder`` (a URI in a shared
    store) in ascending doc_id order. Returns the manifest with ``start``, the
    number of ids in all files before."""
    bits = bits_for(vocabulary)
    spark = docs.sparkSession
    src = tk.documents(docs)
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = src.repartitionByRange(partitions_for(src, 16 << 20), *keys).sortWithinPartitions(*keys)

    def write(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        encoder = worker_encoder(path, special_as_text)
        store, root = open_store(folder)
        ids, doc_ids, lens, seq = [], [], [], 0

        def flush():
            all_ids = np.concatenate(ids)
            name = f"part-{pid:06d}-{seq:05d}-{os.urandom(6).hex()}.tpk"
            with store.open_output_stream(f"{root}/{name}") as out:
                for b in file_bytes(doc_ids, lens, all_ids, bits, vocabulary, block):
                    out.write(b)
            return pa.RecordBatch.from_pydict({
                "path": pa.array([name]), "pid": pa.array([pid], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([len(all_ids)], pa.int64())})

        for batch in batches:
            for part in tk.slices(batch, "text", 4 << 20):
                x, n = encoder.encode(part.column("text"), end_id)
                ids.append(x)
                lens += n
                doc_ids += part.column("doc_id").to_pylist()
                if sum(map(len, ids)) >= file_ids:
                    yield flush()
                    ids, doc_ids, lens, seq = [], [], [], seq + 1
        if doc_ids:
            yield flush()

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    manifest = tk.cut_lineage(ordered.mapInArrow(write, MANIFEST), "manifest")
    # A partition's first id is a prefix sum over the partitions, a file's one over the files of its partition.
    totals = manifest.groupBy("pid").agg(F.sum("n_ids").alias("n")).select("pid", F.lit(0).alias("g"), "n", F.lit(0).alias("at"))
    offsets = partition_offsets(totals, "pid", "g", "n", "base").drop("g")
    w = Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (manifest.withColumn("_b", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))
            .join(offsets, "pid").withColumn("start", F.col("base") + F.col("_b")).drop("_b", "base"))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files."""

    def read(batches):
        import pyarrow as pa

        store, root = open_store(folder)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as handle:
                    f = TokenFile(handle)
                    s = f.doc_start
                    ids = f.ids(0, f.n_ids).astype("<u4", copy=False)
                    raw = memoryview(ids).cast("B")
                    crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(f.doc_ids, pa.int64(), mask=~f.has_id),
                        "start": pa.array(s[:-1] + start), "n_tokens": pa.array(np.diff(s)),
                        "ids_crc32": pa.array(crc, pa.int64())})

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, special_as_text: bool = False) -> DataFrame:
    """Writes the token files of ``docs`` under the checkpoint folder and
    returns what is read back from them."""
    from tokenizers import Tokenizer

    folder = tk.scratch_path(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, path, folder, Tokenizer.from_file(path).get_vocab_size(), end_id,
                            special_as_text=special_as_text)
    return read_tokens(manifest, folder)
