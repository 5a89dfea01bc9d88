"""A third of all messages from one user: exact results, work split over tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from segmenter.operators.history import newest_first_positions
from segmenter.operators.throttle import Fold, entry_states, mute_fold, ordered_messages, trailing_count
from segmenter.sources.tables import message_log
from test_throttle import brute_fold, micros


def skewed(spark):
    m = message_log(spark, SF_MID)
    return m.withColumn("user_id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))


def test_hot_user_fold_is_exact_and_split(spark):
    m = skewed(spark)
    rows = [(r["user_id"], r["id"], micros(r["timestamp"])) for r in m.collect()]
    hot = sum(1 for u, _, _ in rows if u == 7)
    assert hot > len(rows) / 3
    exp = brute_fold(rows, 5, 3600 * 10**6, 1800 * 10**6)
    got = {r["id"]: r["status"] for r in mute_fold(m, 5, 3600, 1800).collect()}
    assert got == exp
    exp = brute_fold(rows, 1, 60 * 10**6, 60 * 10**6)
    got = {r["id"]: r["status"] for r in mute_fold(m, 1, 60, 60).collect()}
    assert got == exp


@pytest.mark.parametrize("limit, window, mute, step", [(15, 30, 30, 3), (15, 30, 30, 1), (5, 30, 7, 2), (2, 60, 60, 0), (40, 60, 30, 1)])
def test_unbroken_user_is_folded_in_pieces(spark, limit, window, mute, step):
    """A user who never pauses: steady under the limit, steady over it, irregular (step 0)."""
    rng = random.Random(limit)
    at, rows = 0.0, []
    for i in range(6000):
        at += step or rng.expovariate(1 / 8)
        rows.append((i, 7, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at)))
    rows += [(10_000 + i, None if i % 2 else 9, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id LONG, user_id LONG, timestamp TIMESTAMP_NTZ").repartition(4)
    exp = brute_fold([(-1 if u is None else u, i, micros(t)) for i, u, t in rows], limit, window * 10**6, mute * 10**6)
    got = mute_fold(df, limit, window, mute, num_partitions=12).collect()
    assert {r["id"]: r["status"] for r in got} == exp and sum(r["user_id"] is None for r in got) == 100
    ordered = ordered_messages(df, num_partitions=12)
    parts = [r["count"] for r in ordered.where("u = 7").groupBy("_pid").count().collect()]
    assert len(parts) >= 8 and max(parts) < 1500
    _, rounds = entry_states(ordered, Fold(limit, window * 10**6, mute * 10**6))
    if step in (0, 3):  # states meet inside a piece: nothing is passed on
        assert rounds <= 2


def test_messages_that_do_not_count(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 1, base + dt.timedelta(seconds=i), i % 2 == 0) for i in range(20)] + [(50, 1, None, True), (51, 1, base, None)]
    df = spark.createDataFrame(rows, "id LONG, user_id LONG, timestamp TIMESTAMP_NTZ, c BOOLEAN")
    got = {r["id"]: r["status"] for r in mute_fold(df, 3, 30, 30, counts_towards_limit=F.col("c")).collect()}
    exp = brute_fold([(1, i, micros(t)) for i, _, t, c in rows if c and t], 3, 30 * 10**6, 30 * 10**6)
    assert got == {**{i: "ok" for i, *_ in rows}, **exp} and got[6] == "mute_start" and got[8] == "suppressed" and got[7] == "ok"
    assert mute_fold(df.where("false"), 3, 30, 30).count() == 0


def test_hot_user_windows(spark):
    m = skewed(spark)
    rows = [(r["user_id"], r["id"], micros(r["timestamp"])) for r in m.collect()]
    got = {r["id"]: r["recent"] for r in trailing_count(m, 3600, bucket_seconds=6 * 3600).collect()}
    by_user = {}
    for u, i, t in rows:
        by_user.setdefault(u, []).append(t)
    import bisect
    for ts in by_user.values():
        ts.sort()
    for u, i, t in rows:
        ts = by_user[u]
        assert got[i] == bisect.bisect_right(ts, t) - bisect.bisect_left(ts, t - 3600 * 10**6)
    pos = {r["id"]: r["rn"] for r in newest_first_positions(m).collect()}
    order = sorted((r for r in rows if r[0] == 7), key=lambda r: (-r[2], -r[1]))
    assert [pos[i] for _, i, _ in order] == list(range(1, len(order) + 1))
