"""The pipeline's stages on rows with edge cases: each decision takes effect."""

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from segmenter.sources.tables import table

from .conftest import ROWS


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(13, 1), (9, 0)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20, 32)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    yield d
    shutil.rmtree(d)


def test_a_text_goes_only_if_one_like_it_stays(spark):
    """An id that repeats with a copy of another document and with a text of its own."""
    other = " ".join(f"u{i}" for i in range(60))
    rows = [(0, ROWS[4][1], "en"), (1, ROWS[4][1] + " end", "en"), (1, other, "en"), (2, other + " too", "de"), (2, "", "x"), (2, "", "x"),
            (3, other, "a"), (None, other, "b"), (4, "alone", "a"), (4, "alone", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("_of", "_text_hash", "_mark", "_copy", "rep", "g", "text_hash"):
        df = df.withColumn(c, F.lit("clash"))
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns and kept.select("_mark", "_copy").distinct().collect() == [("clash", "clash")]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept.collect()) == sorted(
        [(0, ROWS[4][1]), (1, other), (2, ""), (-1, other), (4, "alone")])
    assert corpus_pipeline.drop_near_duplicates(spark, df.where("false"), "").count() == 0


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        if name == "near_duplicates":  # one of a group of near copies
            assert {5, 6, 7, 8} & {r["doc_id"] for r in docs.select("doc_id").collect()} == {5}
    left = {(r["doc_id"], r["text"]) for r in docs.collect()}
    ids = {d for d, _ in left}
    assert 5 not in ids  # holds the benchmark passage
    assert (9, ROWS[8][1]) in left and (4, "word") in left and (1, None) in left  # clean rows stay
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.count() == docs.count() and set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256"}


def test_passages_of_over_fifty_words_are_cut_whatever_their_bytes(spark):
    """Against brute force: shared runs of 49 to 56 short words, with other blanks, at edges, several times in one text."""
    import random
    import re
    rnd = random.Random(3)
    shared = [[f"s{k}{rnd.choice('abc')}{i}" for i in range(n)] for k, n in enumerate((49, 50, 51, 52, 56, 56))]
    texts = []
    for d in range(60):
        parts = [[f"o{d}x{j}{i}" for i in range(rnd.randrange(1, 30))] for j in range(4)]
        for at in range(3):
            if rnd.random() < 0.5:
                run = rnd.choice(shared)
                parts.insert(rnd.randrange(len(parts) + 1), run if rnd.random() < 0.6 else run[rnd.randrange(4):])
        texts.append(rnd.choice([" ", "\n", "  "]).join(w for p in parts for w in p) + rnd.choice(["", " ", "\n"]))
    texts += ["", None, "one two", "\u00e9 " * 60, " ".join(shared[5])]
    words = [[(m.group(), len((t or "")[:m.start()].encode()), len((t or "")[:m.end()].encode())) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
             for t in texts]
    seen = {}
    for ws in words:
        for i in range(len(ws) - 50):
            key = tuple(w for w, _, _ in ws[i:i + 51])
            seen[key] = seen.get(key, 0) + 1
    want = {}
    for d, (t, ws) in enumerate(zip(texts, words, strict=True)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(ws) - 50):
            if seen[tuple(w for w, _, _ in ws[i:i + 51])] > 1:
                a, b = ws[i][1], ws[i + 50][2]
                gone[a:b] = b"x" * (b - a)
        for i in range(len(raw) - 399):
            if sum(x.count(raw[i:i + 400]) for x in raws(texts)) > 1 or raw.find(raw[i:i + 400], i + 1) >= 0:
                gone[i:i + 400] = b"x" * 400
        want[d] = None if t is None else bytes(c for c, g in zip(raw, gone, strict=True) if not g).decode()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, df, "").collect()}
    assert {d: r["text"] for d, r in got.items()} == want
    assert any(len(want[d]) < len(t) for d, t in enumerate(texts[:60])) and got[64]["text"] == "" and got[64]["n_chars"] == 0


def raws(texts):
    return [(t or "").encode() for t in texts]
