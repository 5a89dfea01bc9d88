"""Ranked search, chat formatting and whitening against brute force, on rows with edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from segmenter.llm import chat_format, fptree_search, whitening
from segmenter.llm.queries import ORACLE_SQL, QUERIES

from .conftest import ROWS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CHAT = P.path("byte_bpe_50k.json")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


# --- ranked search ------------------------------------------------------------

def brute_ranking(rows, items, k):
    docs = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in rows) if t]
    n_docs, n_words = len(docs), sum(n for _, _, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in docs:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m))
                    for w in terms(text) if c[w])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


ITEMS = [(1, "the quick brown fox jumps over a lazy dog"), (2, None), (3, " .. "), (4, "w1 w1 w2 w150 unseen"), (5, prose(3, 30)),
         (5, "quiet rivers QUIET"), (None, "licensed idiot scum"), (7, " ".join(f"t{i}" for i in range(120)))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("row", F.lit("x")).withColumn("terms", F.lit(0))


def long_rows():
    """A text over a mebibyte and groups of copies, beside the edge cases."""
    rows = [(r[0], r[1]) for r in ROWS] + [(1000 + i, "seven wizards box with quiet rivers") for i in range(60)]
    return rows + [(900, "rivers " + " ".join(f"x{i % 5000} quick" for i in range(140_000)))]


@pytest.mark.parametrize("options", [{}, {"k": 3, "leaf": 2, "segment_docs": 7, "block_cells": 300}])
def test_ranking(spark, docs, items, options):
    more = spark.createDataFrame([r for r in long_rows() if r[0] and r[0] >= 900], "doc_id long, text string").repartition(2)
    both = docs.unionByName(more, allowMissingColumns=True)
    got = fptree_search.rank_documents(both, items, **options)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(tuple(r) for r in got.collect()) == brute_ranking(long_rows(), ITEMS, options.get("k", 20))


def test_ranking_of_nothing(docs, items, empty):
    assert fptree_search.rank_documents(empty, items).count() == 0
    assert fptree_search.rank_documents(docs, items.where("false")).count() == 0
    assert fptree_search.rank_documents(docs, items.where("item_id in (2, 3)")).count() == 0


def tree_of(rows, leaf):
    vocabulary = sorted({w for _, t in rows for w in terms(t)})
    vectors = [Counter(terms(t)) for _, t in rows]
    df = Counter(w for c in vectors for w in c)
    rank = np.empty(len(vocabulary), np.int64)
    rank[sorted(range(len(vocabulary)), key=lambda i: -df[vocabulary[i]])] = np.arange(len(vocabulary))
    at = {w: i for i, w in enumerate(vocabulary)}
    flat = [(at[w], n) for c in vectors for w, n in sorted(c.items())]
    starts = np.r_[0, np.cumsum([len(c) for c in vectors])]
    m = np.array([80 + len(terms(t)) for _, t in rows])
    weights = np.array([1 + i % 50 for i in range(len(vocabulary))])
    return fptree_search.Tree(starts, np.array([t for t, _ in flat]), np.array([n for _, n in flat]), m, rank, weights, leaf), vocabulary


def test_bounds_hold_and_prune():
    rng = random.Random(5)
    rows = [(i, " ".join(f"c{rng.randint(0, 9)}" for _ in range(6)) + " " + " ".join(f"r{rng.randint(0, 400)}" for _ in range(4))) for i in range(3000)]
    tree, vocabulary = tree_of(rows, 16)
    counts = np.zeros((len(vocabulary), 2))
    counts[[vocabulary.index(w) for w in ("c1", "c2", "r7", "r8")], 0] = 1
    counts[[vocabulary.index(w) for w in terms(rows[11][1])], 1] = 1
    stack, leaves = [(0, 3000, 0)], []
    while stack:
        lo, hi, depth = stack.pop()
        seen, parts = tree.bound_parts(lo, hi)
        bound = fptree_search.product(parts[None, :], counts[seen])[0]
        assert (tree.leaf_scores(lo, hi, counts) <= bound).all()
        if hi - lo > 16:
            stack += tree.children(lo, hi, depth)
        else:
            leaves += range(lo, hi)
    assert sorted(leaves) == list(range(3000))
    hits = fptree_search.Hits(2, 5)
    scored = fptree_search.search_segment(tree, np.arange(3000), np.zeros(3000, bool), counts, hits)
    assert scored < 0.8 * 6000
    every = tree.leaf_scores(0, 3000, counts)
    for i in range(2):
        order = np.lexsort((tree.docs, -every[:, i]))[:5]
        assert hits.doc[i].tolist() == tree.docs[order].tolist() and hits.score[i].tolist() == every[order, i].tolist()


def test_product_beyond_doubles():
    parts, counts = np.array([[2**40 + 1, 3]]), np.array([[2.0**20 + 1], [1.0]])
    assert fptree_search.product(parts, counts).tolist() == [[(2**40 + 1) * (2**20 + 1) + 3]]


# --- chat formatting ------------------------------------------------------------

CHATS = [(1, 0, "user", "hi <|im_end|> there"), (1, 1, "assistant", "  leading\nand trailing  "), (1, 2, "assistant", ""), (1, 3, "assistant", "<"),
         (1, 4, "assistant", "\\| <\\|im_start|> <|endoftext|>"), (2, 0, "system", None), (2, 1, None, "no role"), (3, None, "assistant", "null turn"),
         (3, 5, "user", "tie b"), (3, 5, "user", "tie a"), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (None, 0, "assistant", "🙂 日本 é"),
         (None, 1, "<|im_sep|>", "odd role"), (4, 0, "assistant", "long one. " * 130_000 + "x" * 40_000)] + [
         (5, i, "assistant" if i % 2 else "user", prose(i, 40)) for i in range(120)]


def digests(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv),
                                                            key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        formatted = sum(len(f"<|im_start|>{chat_format.escape(r)}<|im_sep|>{chat_format.escape(t)}<|im_end|>") for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), formatted))
    return Counter(out)


@pytest.fixture(scope="module")
def chats(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(3)
    for c in ("part", "whole", "ids", "loss", "_pid", "long", "size"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("part_bytes", [1 << 20, 1000])
def test_chats_read_back(chats, part_bytes):
    formatted = chat_format.format_conversations(chats, CHAT, part_bytes=part_bytes)
    if part_bytes == 1000:
        assert formatted.where("conv_id = 5").count() > 3
    got = chat_format.read_back(formatted, CHAT)
    assert Counter(tuple(r)[:6] for r in got.collect()) == digests(CHATS)


def test_chat_masks_are_whole_tokens(chats):
    enc = chat_format.encoder(CHAT)
    for r in chat_format.format_conversations(chats.where("conv_id in (1, 3)"), CHAT).collect():
        whole = enc.tok.encode(r["text"], add_special_tokens=False)
        assert whole.ids == r["ids"]  # pieces encode as the whole does
        texts = [t for role, t in chat_format.parse(r["text"]) if role == "assistant" and t]
        runs = list(zip(r["loss"][::2], r["loss"][1::2], strict=True))
        assert [chat_format.unescape(r["text"][whole.offsets[a][0]:whole.offsets[b - 1][1]]) for a, b in runs] == texts


def test_escape_and_pieces(monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE", 16)
    rng, enc = random.Random(1), chat_format.encoder(CHAT)
    parts = ["a", "the", " ", "\n", "  ", "<", "|", "\\", "<|", "|>", "<|im_end|>", "<|endoftext|>", "é", "🙂", "1", "'s", ".", "\x1c", " ", " ", "日本"]
    for _ in range(2000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        e = chat_format.escape(t)
        assert "<|" not in e and chat_format.unescape(e) == t
        ids = enc.encode(e)
        assert ids.tolist() == enc.tok.encode(e, add_special_tokens=False).ids and enc.decode(ids) == e.encode()


def test_no_chats(chats):
    formatted = chat_format.format_conversations(chats.where("false"), CHAT)
    assert formatted.count() == 0 and chat_format.read_back(formatted, CHAT).count() == 0


# --- whitening ------------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6)) * 0.2
    rows = [(i, [float(v) for v in np.float32(base[i % 40])]) for i in range(70)]
    rows += [(500 + i, rows[3][1]) for i in range(50)] + [(3, rows[4][1]), (None, rows[5][1])]
    bad = [(900, None), (901, [None] + rows[0][1][1:]), (902, [float("nan")] + rows[0][1][1:]), (903, [float("inf")] * 6), (904, [1e30] * 6), (905, [])]
    return rows, bad


def whitened_by_hand(rows, weights, k=8):
    x = np.floor(1024 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 100_000
    fit = x if weights == "counts" else np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    z = (x - s / n) @ v / np.sqrt(e)
    return n, ((n * x - s) ** 2).sum(axis=1), z, e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("weights", ["counts", "one"])
@pytest.mark.parametrize("heavy", [1000, 3])
def test_whitening(spark, weights, heavy):
    good, bad = vectors()
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").repartition(3)
    for c in ("x", "w", "k1", "d", "z", "n", "id"):
        df = df.withColumn(c, F.lit("clash"))
    got = whitening.whitened_components(df, weights=weights, heavy=heavy).collect()
    n, deviation, z, explained = whitened_by_hand(good, weights)
    assert len(got) == 6 * len(good) and {r["n"] for r in got} == {n} and {r["identity_error"] for r in got}.pop() < 1e-9
    signs = {}
    want = Counter((i, d) for (i, _), d in zip(good, deviation.tolist(), strict=True))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == want
    for r in got:
        rows = [j for j, (i, _) in enumerate(good) if i == r["vec_id"] and deviation[j] == r["deviation"]]
        c = r["component"] - 1
        assert abs(r["explained"] - explained[c]) < 1e-9
        assert min(abs(abs(z[j, c]) - abs(r["whitened"])) for j in rows) < 1e-6
        if abs(r["whitened"]) > 1e-3:
            signs.setdefault(c, set()).add(bool(np.sign(z[rows[0], c]) == np.sign(r["whitened"])))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_without_variance_and_of_nothing(spark):
    kind = "vec_id long, embedding array<double>"
    same = whitening.whitened_components(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], kind)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    assert whitening.whitened_components(spark.createDataFrame([], kind)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [2.0]), (4, [4.0]), (5, [6.0])], kind)).collect()
    assert {(r["vec_id"], r["n"], r["width"]) for r in two} == {(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 3, 1), (5, 3, 1)}


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [1e12 * (i == 0), float(i)]) for i in range(3)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: None, 1: None, 2: None}
    x = np.array([[1024 * 10**6, 0], [0, 1024], [0, 2048]], dtype=object) + 100_000
    rows = [(i, [1e6 * (i == 0), float(i)]) for i in range(3)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: int(((3 * x[i] - x.sum(axis=0)) ** 2).sum()) for i in range(3)}


# --- SQL --------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    df = QUERIES[name](spark, sf)
    assert df.columns == [c[0] for c in want.description]
    assert Counter(tuple(r) for r in df.collect()) == Counter(want.fetchall())
