import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from segmenter.operators.chunk import chunk_text
from segmenter.sources.tables import table


def reference_parts(text, n):
    """Intended rule: longest prefix <= n followed by a newline or the end, else n."""
    parts = []
    while text:
        if len(text) <= n:
            parts.append(text)
            break
        cut = max((e for e in range(1, n + 1) if text[e] == "\n"), default=n)
        parts.append(text[:cut])
        text = text[cut:]
    return parts


def test_chunks_on_documents(spark):
    docs = table(spark, SF_SMALL, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for n in (4096, 300):
        got = {}
        for r in chunk_text(docs, "text", "doc_id", n).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r["doc_id"], []).append(r["chunk"])
        for k, t in texts.items():
            exp = reference_parts(t or "", n)
            assert got.get(k, []) == exp
            assert "".join(got.get(k, [])) == (t or "")
            assert all(len(p) <= n for p in got.get(k, []))


def test_chunks_edge_cases(spark):
    rnd = random.Random(3)
    cases = ["x" * 25, "\n" + "y" * 12, "ab\ncd\nef", "a" * 10, "\n\n\n", "é" * 7 + "\n" + "ü" * 9]
    cases += ["".join(rnd.choice("ab\n") for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(cases)), "id INT, t STRING")
    got = {}
    for r in chunk_text(df, "t", "id", 10).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    for i, t in enumerate(cases):
        assert got[i] == reference_parts(t, 10), t
