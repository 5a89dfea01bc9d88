import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from segmenter.operators.knn import find_recommendations, knn_join
from segmenter.operators.upsert import delete_keys, upsert
from segmenter.sources.tables import corpus, requests_from_embeddings


def test_blocked_equals_broadcast_and_brute_force(spark):
    reqs = requests_from_embeddings(spark, SF_SMALL)
    c = corpus(spark, SF_SMALL)
    a = {(r["request_id"], r["hit_rank"]): r["corpus_id"] for r in knn_join(reqs, c, ["language"]).collect()}
    b = {(r["request_id"], r["hit_rank"]): r["corpus_id"] for r in
         knn_join(reqs, c, ["language"], force_blocked=True, block_rows=16).collect()}
    assert a == b
    rows = c.collect()
    vec = {r["id"]: np.array(r["embedding"], dtype=float) for r in rows}
    lang = {r["id"]: r["language"] for r in rows}
    for rid in list(vec)[:25]:
        cand = sorted((float(np.sqrt(((vec[rid] - vec[j]) ** 2).sum())), j) for j in vec if lang[j] == lang[rid])
        assert [a[(rid, k)] for k in (1, 2, 3)] == [j for _, j in cand[:3]]


def test_single_request_plan_is_top_k(spark):
    c = corpus(spark, SF_SMALL)
    q = c.first()["embedding"]
    df = find_recommendations(c, q, "ru" if c.first()["language"] == "ru" else "en", limit=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert df.count() == 3


def test_upsert_last_write_wins_and_idempotent(spark):
    cur = spark.createDataFrame([(1, "a", "Z1"), (2, "b", "Z2")], "id LONG, name STRING, zone STRING")
    chg = spark.createDataFrame([(1, "a2", None, 5), (1, "a3", None, 7), (3, "c", None, 1)],
                                "id LONG, name STRING, zone STRING, _version LONG")
    out = upsert(cur, chg, "id", columns=["name"], defaults={"zone": "Europe/Moscow"})
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, "a3", "Z1"), (2, "b", "Z2"), (3, "c", "Europe/Moscow")]
    again = sorted(tuple(r) for r in upsert(out, chg, "id", columns=["name"]).collect())
    assert again == got
    assert sorted(r["id"] for r in delete_keys(out, spark.createDataFrame([(1,)], "id LONG"), "id").collect()) == [2, 3]


def test_create_tables_idempotent(spark):
    import tempfile
    from segmenter.sources.sinks import create_tables
    base = tempfile.mkdtemp(prefix="segmenter-tables-")
    paths = create_tables(spark, base)
    again = create_tables(spark, base)
    assert paths == again
    assert spark.read.parquet(paths["users"]).columns == ["id", "username", "first_name", "timezone",
                                                          "timezone_set"]
    assert spark.read.parquet(paths["messages_history"]).count() == 0


def test_history_of_pushes_the_key(spark):
    from segmenter.operators.history import history_of
    from segmenter.sources.tables import table
    e = table(spark, SF_SMALL, "events").select(F.col("event_id").alias("id"), "user_id",
                                                F.col("ts").alias("timestamp"))
    df = history_of(e, 7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan
    rows = df.collect()
    assert all(r["user_id"] == 7 for r in rows)
    assert [r["timestamp"] for r in rows] == sorted((r["timestamp"] for r in rows), reverse=True)


@pytest.mark.parametrize("blocked", [False, True])
def test_knn_without_hits_and_with_ragged_corpus(spark, blocked):
    from segmenter.errors import DataQualityError
    from segmenter.operators.knn import knn_join
    asked = spark.createDataFrame([(1, "xx", [1.0, 2.0])], "request_id LONG, language STRING, query_vec ARRAY<DOUBLE>")
    schema = "id LONG, language STRING, segment STRING, recommendation STRING, embedding ARRAY<DOUBLE>"
    corpus = spark.createDataFrame([(1, "en", "a", "t", [1.0, 2.0])], schema)
    assert knn_join(asked, corpus, ["language"], force_blocked=blocked).count() == 0
    ragged = corpus.union(spark.createDataFrame([(2, "en", "a", "t", [1.0])], schema))
    with pytest.raises(DataQualityError):
        knn_join(asked, ragged, ["language"], force_blocked=blocked)


def test_request_without_a_vector_has_no_hits_on_either_route(spark):
    from segmenter.operators.knn import knn_join
    corpus = spark.createDataFrame([(i, "s", "en", f"r{i}", [float(i), 1.0]) for i in range(9)],
                                   "id LONG, segment STRING, language STRING, recommendation STRING, embedding ARRAY<DOUBLE>")
    reqs = spark.createDataFrame([(1, "en", [2.0, 1.0]), (2, "en", None)], "request_id LONG, language STRING, query_vec ARRAY<DOUBLE>")
    for blocked in (False, True):
        hits = knn_join(reqs, corpus, ["language"], k=2, force_blocked=blocked, block_rows=3).collect()
        assert sorted((r["request_id"], r["hit_rank"], r["corpus_id"]) for r in hits) == [(1, 1, 2), (1, 2, 1)]


def _scan(q, ids, mat, k):
    d = np.sqrt(((q[:, None, :] - mat[None, :, :]) ** 2).sum(axis=2))
    return [[(int(ids[j]), float(row[j])) for j in np.lexsort((ids, row))[:k] if not np.isnan(row[j])] for row in d]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_tile_equals_a_plain_scan(block):
    from segmenter.operators.knn import Tile
    rng = np.random.default_rng(5)
    mat = np.r_[rng.integers(0, 3, (200, 4)).astype(float), rng.normal(size=(100, 4)) * 1e-9 + 1e6, rng.normal(size=(50, 4)) * 1e200,
                [[np.inf, 0, 0, 0], [np.nan, 0, 0, 0]]]
    ids = rng.permutation(len(mat))
    q = np.r_[mat[::3], rng.normal(size=(20, 4)), [[1e6] * 4], [[np.inf, 1, 1, 1]]]
    got = [[] for _ in q]
    with np.errstate(all="ignore"):
        for rows, ranks, at, dist in Tile(ids, mat, None).nearest(q, 5, block):
            for r, rank, j, d in zip(rows, ranks, at, dist):
                assert rank == len(got[r])
                got[r].append((int(ids[j]), float(d)))
        assert got == _scan(q, ids, mat, 5)


def test_scoring_memory_does_not_grow_with_the_corpus():
    import tracemalloc

    from segmenter.operators.knn import Tile
    rng = np.random.default_rng(1)
    tile, q = Tile(np.arange(60_000), rng.normal(size=(60_000, 16)), None), rng.normal(size=(64, 16))
    tracemalloc.start()
    assert sum(len(x[0]) for x in tile.nearest(q, 3, 4096)) == 64 * 3
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak  # 32 requests x corpus x width in doubles would be 246 MB


def test_blocked_route_sends_a_request_once_per_tile(spark, monkeypatch):
    from segmenter.operators import knn
    rows = [(i, "en", f"r{i}", [float(i % 40), float(i // 40)]) for i in range(400)] + [(1000 + i, "en", f"c{i}", [3.0, 3.0]) for i in range(50)]
    corpus = spark.createDataFrame(rows, "id LONG, language STRING, recommendation STRING, embedding ARRAY<DOUBLE>")
    reqs = corpus.select(F.col("id").alias("request_id"), "language", F.col("embedding").alias("query_vec"))
    mat, ids = np.array([r[3] for r in rows]), np.array([r[0] for r in rows])
    want = {r[0]: [i for i, _ in hits] for r, hits in zip(rows, _scan(mat, ids, mat, 3))}
    for tile_bytes in (1 << 24, 16 * 64):  # one tile; some tiles and slices
        monkeypatch.setattr(knn, "TILE_BYTES", tile_bytes)
        hits = knn.knn_join(reqs, corpus, ["language"], k=3, payload=["recommendation"], force_blocked=True, block_rows=4)
        got = {}
        for r in sorted(hits.collect(), key=lambda r: (r["request_id"], r["hit_rank"])):
            got.setdefault(r["request_id"], []).append(r["corpus_id"])
        assert got == want
    tiles = []
    cut = knn.cut_lineage
    monkeypatch.setattr(knn, "TILE_BYTES", 1 << 24)
    monkeypatch.setattr(knn, "cut_lineage", lambda df, name: tiles.append((name, cut(df, name))) or tiles[-1][1])
    knn.knn_join(reqs, corpus, ["language"], k=3, payload=["recommendation"], force_blocked=True, block_rows=4)
    assert [(r["_tiles"], r["_slices"]) for r in dict(tiles)["knn-sizes"].collect()] == [(1, 1)]  # not one per block
