import datetime as dt
from collections import deque

from pyspark.sql import functions as F

from conftest import SF_SMALL
from segmenter.operators.throttle import mute_fold, trailing_count
from segmenter.sources.tables import message_log


def brute_fold(rows, limit, window_us, mute_us):
    out, by_user = {}, {}
    for u, i, us in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        kept, muted = by_user.setdefault(u, [deque(), None])
        if muted is not None and us < muted:
            out[i] = "suppressed"
            continue
        kept.append(us)
        while kept[0] < us - window_us:
            kept.popleft()
        if len(kept) > limit:
            out[i] = "mute_start"
            by_user[u][1] = us + mute_us
        else:
            out[i] = "ok"
    return out


def micros(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_fold_matches_brute_force_on_events(spark):
    m = message_log(spark, SF_SMALL)
    rows = [(r["user_id"], r["id"], micros(r["timestamp"])) for r in m.collect()]
    for limit, w, mu in [(3, 86400, 86400), (2, 3600 * 6, 3600), (15, 30, 30)]:
        exp = brute_fold(rows, limit, w * 10**6, mu * 10**6)
        got = {r["id"]: r["status"] for r in mute_fold(m, limit, w, mu).collect()}
        assert got == exp


def test_hot_user_and_boundaries(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    # One user with most of the rows, bursts separated by quiet gaps.
    for b in range(40):
        for j in range(20):
            rows.append((b * 1000 + j, 7, base + dt.timedelta(hours=b, seconds=j)))
    rows += [(10**6 + j, 8, base + dt.timedelta(seconds=2 * j)) for j in range(30)]
    df = spark.createDataFrame(rows, "id LONG, user_id LONG, timestamp TIMESTAMP_NTZ")
    got = {r["id"]: r["status"] for r in mute_fold(df, 15, 30, 30).collect()}
    exp = brute_fold([(u, i, micros(t)) for i, u, t in rows], 15, 30 * 10**6, 30 * 10**6)
    assert got == exp
    # 16 messages within 30 s: the 16th starts the mute.
    assert got[15] == "mute_start" and got[16] == "suppressed"


def test_message_at_unmute_time_is_allowed(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 1, base + dt.timedelta(seconds=i)) for i in range(3)] + [(9, 1, base + dt.timedelta(seconds=2 + 30))]
    df = spark.createDataFrame(rows, "id LONG, user_id LONG, timestamp TIMESTAMP_NTZ")
    got = {r["id"]: r["status"] for r in mute_fold(df, 2, 30, 30).collect()}
    assert got == {0: "ok", 1: "ok", 2: "mute_start", 9: "ok"}


def test_trailing_count_matches_brute_force(spark):
    m = message_log(spark, SF_SMALL)
    rows = [(r["user_id"], r["id"], micros(r["timestamp"])) for r in m.collect()]
    for w in (30, 3600, 86400):
        got = {r["id"]: r["recent"] for r in trailing_count(m, w, bucket_seconds=w).collect()}
        exp = {i: sum(1 for u2, _, t2 in rows if u2 == u and us - w * 10**6 <= t2 <= us) for u, i, us in rows}
        assert got == exp
