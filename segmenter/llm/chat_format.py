"""Chat formatting with a loss mask aligned to tokens by their offsets.

Template, for every turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``. The three
marks are added to the tokenizer as special tokens, so no token crosses a mark.

Escaping: a control string begins with ``<|``. In roles and texts ``<``, any
number of backslashes and ``|`` get one backslash more; reading takes one away.
That is reversible, and no role or text holds a control string afterwards.

Formatting: a conversation is rendered whole and encoded once. Tokens are
lossless on bytes, so their offsets are the running sums of the tokens' byte
lengths. The spans of the turns that count (by role) and the spans of the tokens
are both sorted: the first and last token of a turn are found by binary search,
and the mask is kept as (first token, one past the last) of each such turn.

Layout: the conversations are range-partitioned by id and sorted by turn, and
every task streams its rows. A conversation of more than ``part_bytes`` is also
split by turn over partitions and written in several parts of about that size,
cut between turns, where a mark keeps the encodings independent. Encoding goes
in pieces of at most about ``PIECE`` characters that end before a blank, where
the tokenizer's pattern always cuts, so a very long text is held as bytes and
ids only.

Reading back: a conversation in one part is read where it lies. Only the parts
of long ones are brought together, in order, and streamed: a digest of a whole
conversation is sequential, so one task reads all parts of such a conversation,
a bounded part at a time.

Defined results: a null text or role is empty; turns go by number, nulls first,
ties by role and text; repeated rows are repeated turns; a null ``conv_id`` is a
conversation of its own; a turn without text has no token under the mask; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions_for
from . import textkit as tk

# The marks of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARKS = [START, SEP, END]
PIECE = 1 << 15
FORMAT = "conv_id long, part long, whole boolean, n_turns long, text string, ids array<int>, loss array<int>"
REPORT = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_tokens long, loss_tokens long")
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
# Before a blank or line end that follows neither white space nor a control character.
_CUT = re.compile(r"(?<=[^\s\x00-\x1f\x7f-\x9f])[ \n]")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "<" + m[1] + "|", text)


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(rendered)]


class ChatEncoder:
    """Byte-level tokenizer with the template's marks, and the bytes of its tokens."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.add_special_tokens([AddedToken(m, normalized=False) for m in MARKS])
        added = self.tok.get_added_tokens_decoder()
        # Byte-level vocabularies write a byte as a character: itself if printable, else one from 256 up.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        self.bytes_of = [b""] * self.tok.get_vocab_size(with_added_tokens=True)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = token.encode() if i in added else bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        bad = [t.content for t in added.values() if not t.content.startswith("<|")]
        if bad:
            raise ValueError(f"control strings that the escape does not cover: {bad}")

    def encode(self, text: str) -> np.ndarray:
        """Token ids; equal to encoding the text in one call."""
        pieces, at = [], 0
        while len(text) - at > PIECE:
            cut = _CUT.search(text, at + PIECE)
            if not cut:
                break
            pieces.append(text[at:cut.start()])
            at = cut.start()
        pieces.append(text[at:])
        return np.concatenate([np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)])

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> ChatEncoder:
    return ChatEncoder(path)


def token_spans(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """(first token, one past the last) of each byte span; ``offsets`` are the
    tokens' starts and, at the end, where the last one ends. Both are sorted."""
    first = np.searchsorted(offsets[1:], spans[:, 0], "right")
    last = np.searchsorted(offsets[:-1], spans[:, 1], "left")
    return np.stack([first, np.maximum(first, last)], axis=1)


def render(turns: list[tuple[str, str]], roles: frozenset[str]) -> tuple[str, np.ndarray]:
    """Rendered turns, and the byte spans of the texts whose role counts."""
    out, spans, at = [], [], 0
    marks = [len(m) for m in MARKS]
    for role, text in turns:
        head, body = escape(role), escape(text)
        a = at + marks[0] + len(head.encode()) + marks[1]
        b = a + len(body.encode())
        if role in roles and b > a:
            spans.append((a, b))
        at = b + marks[2]
        out += [START, head, SEP, body, END]
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def _turns(conversations: DataFrame, part_bytes: int) -> DataFrame:
    """The turns under fixed names, with ``whole``: whether the conversation fits in one part."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.sum(F.octet_length("role") + F.octet_length("text") + F.lit(sum(map(len, MARKS))))
    # Long conversations only: no more of them than bytes of input / part_bytes.
    long_ones = (c.groupBy("conv_id").agg(size.alias("size")).where(F.col("size") > part_bytes)
                 .select(F.col("conv_id").alias("long_id"), F.lit(True).alias("long")))
    return c.join(long_ones, F.col("conv_id").eqNullSafe(F.col("long_id")), "left").select(
        "conv_id", "turn", "role", "text", F.col("long").isNull().alias("whole"))


def format_conversations(conversations: DataFrame, tokenizer: str, loss_roles: tuple[str, ...] = ("assistant",),
                         part_bytes: int = 1 << 20) -> DataFrame:
    """Formatted conversations (``FORMAT``), written under the shared checkpoint
    folder: rendered text, token ids and the token runs under the loss mask.
    ``part`` orders the parts of a conversation; ``whole``: it has one part."""
    turns = _turns(conversations, part_bytes)
    # Long conversations are also cut by turn; the others lie in one partition.
    cut = [F.when(~F.col("whole"), F.col(k)) for k in ("turn", "role")] + [F.when(~F.col("whole"), F.substring("text", 1, 64))]
    spread = (turns.repartitionByRange(partitions_for(turns), "conv_id", *cut)
              .sortWithinPartitions("conv_id", "turn", "role", "text"))
    roles = frozenset(loss_roles)

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()),
                            ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.int32()))])
        key, held, size = None, [], 0
        done: list[dict] = []

        def finish():
            text, spans = render(held, roles)
            ids = enc.encode(text)
            offsets = np.r_[0, np.cumsum(enc.lengths[ids])]
            done.append({"conv_id": key[0], "part": key[2] << 33 | key[3], "whole": key[1], "n_turns": len(held), "text": text,
                         "ids": ids, "loss": token_spans(offsets, spans).ravel().astype(np.int32)})

        count, waiting = 0, 0
        for batch in batches:
            for part in tk.slices(batch, "text", part_bytes):
                cols = [part.column(c).to_pylist() for c in ("conv_id", "whole", "_pid", "role", "text")]
                for conv, whole, pid, role, text in zip(*cols, strict=True):
                    if key is None or conv != key[0] or (not whole and size > part_bytes):
                        if held:
                            finish()
                        waiting += size
                        key, held, size = (conv, whole, 0 if whole else pid, 0 if whole else count), [], 0
                        count += 1
                        if waiting > part_bytes:
                            yield pa.RecordBatch.from_pylist(done, schema)
                            done, waiting = [], 0
                    held.append((role, text))
                    size += len(text) + len(role)
        if held:
            finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return tk.cut_lineage(spread.withColumn("_pid", F.spark_partition_id()).mapInArrow(run, FORMAT), "chats")


class _Digest:
    """Digests of one conversation, part by part."""

    def __init__(self, enc: ChatEncoder):
        self.enc = enc
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0

    def add(self, text: str, ids, loss) -> None:
        for role, body in parse(text):
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n += 1
        runs = np.asarray(loss, np.int64).reshape(-1, 2)
        for a, b in runs:
            # Each run is the text of one turn; what its tokens say is what is trained on.
            said = unescape(self.enc.decode(ids[a:b]).decode())
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)
        self.tokens += len(ids)
        self.loss_tokens += int((runs[:, 1] - runs[:, 0]).sum())

    def row(self, conv) -> dict:
        return {"conv_id": conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "n_tokens": self.tokens, "loss_tokens": self.loss_tokens}


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation (``REPORT``) from formatted conversations alone:
    turns from the rendered text, the loss text from the masked tokens."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                            ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())])
        key, open_one = None, None
        for batch in batches:
            out = []
            for part in tk.slices(batch, "text", 1 << 20):
                convs, wholes, texts = (part.column(c).to_pylist() for c in ("conv_id", "whole", "text"))
                ids, loss = part.column("ids"), part.column("loss")
                for i, (conv, whole, text) in enumerate(zip(convs, wholes, texts, strict=True)):
                    if open_one is None or whole or conv != key:
                        if open_one is not None:
                            out.append(open_one.row(key))
                        key, open_one = conv, _Digest(enc)
                    open_one.add(text, ids[i].values.to_numpy(), loss[i].values.to_numpy())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if open_one is not None:
            yield pa.RecordBatch.from_pylist([open_one.row(key)], schema)

    f = formatted.select("conv_id", "part", "whole", "text", "ids", "loss")
    parts = f.where("not whole")
    streamed = parts.repartition(partitions_for(parts), "conv_id").sortWithinPartitions("conv_id", "part")
    cols = ["conv_id", "whole", "text", "ids", "loss"]
    return f.where("whole").select(*cols).mapInArrow(run, REPORT).unionByName(streamed.select(*cols).mapInArrow(run, REPORT))
