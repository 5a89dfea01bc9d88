"""Committed writes of keyed tables: versions, conflicts, replays, files opened."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from segmenter.errors import ConflictError
from segmenter.session import scratch_path
from segmenter.sources.keyed_table import KeyedTable

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id LONG, user_id LONG, message STRING, timestamp TIMESTAMP_NTZ"


def messages(spark, ids, user=lambda i: i % 40):
    return spark.createDataFrame([(i, user(i), f"m{i}", T0 + dt.timedelta(minutes=i)) for i in ids], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark):
    schema = messages(spark, []).schema
    return KeyedTable.create(spark, scratch_path(spark, "keyed"), schema, "user_id", ("timestamp", "id"), buckets=8)


def hot(i):
    return None if i % 50 == 0 else 7 if i % 3 == 0 else i % 40


def test_append_read_and_key(spark, table):
    assert table.read().count() == 0 and table.read_key(7).count() == 0
    all_rows = messages(spark, range(600), hot)
    table.append(messages(spark, range(300), hot))
    table.append(messages(spark, range(300, 600), hot))
    assert rows(table.read()) == rows(all_rows)
    for key in (7, 11, None, 999):
        got = table.read_key(key)
        assert rows(got) == rows(all_rows.where(F.col("user_id").eqNullSafe(F.lit(key).cast("long"))))
        assert len(got.inputFiles()) < len(table.read().inputFiles()) / 3  # one bucket of eight


def test_delete_rewrites_touched_buckets_only(spark, table):
    table.append(messages(spark, range(400)))
    before = table.manifest()
    version = table.delete(spark.createDataFrame([(3,), (3,), (None,), (777,)], "u LONG"), "u")
    after = table.manifest()
    assert after.version == version == before.version + 1
    bucket = spark.range(1).select(table._bucket(after, F.lit(3)).alias("b")).first()["b"]
    moved = {b for b in before.writes if before.writes[b] != after.writes.get(b)}
    assert bucket in moved and len(moved) <= 3  # those of 3, 777 and null at most
    assert rows(table.read()) == rows(messages(spark, range(400)).where("user_id <> 3"))
    # A reader of the version before still sees it whole, and the same change again changes no rows.
    assert rows(table.read(before.version)) == rows(messages(spark, range(400)))
    table.delete(spark.createDataFrame([(3,)], "user_id LONG"))
    assert rows(table.read()) == rows(messages(spark, range(400)).where("user_id <> 3"))


def test_a_deleted_bucket_may_be_empty(spark, table):
    table.append(messages(spark, range(10), lambda i: 1))
    table.delete(spark.createDataFrame([(1,)], "user_id LONG"))
    assert table.read().count() == 0 and table.manifest().writes == {}


def test_replayed_epochs_add_nothing(spark, table):
    for epoch in (0, 1, 1, 0):
        table.append(messages(spark, range(epoch * 100, epoch * 100 + 100)), "w", epoch)
    assert rows(table.read()) == rows(messages(spark, range(200))) and table.manifest().epochs == {"w": 1}
    table.append(messages(spark, range(200, 210)), "other", 0)
    assert table.read().count() == 210


def test_compaction_beside_a_reader(spark, table):
    for k in range(4):
        table.append(messages(spark, range(k * 50, k * 50 + 50)))
    open_frame = table.read()
    assert max(len(w) for w in table.manifest().writes.values()) == 4
    table.compact()
    assert {len(w) for w in table.manifest().writes.values()} == {1}
    assert rows(open_frame) == rows(table.read()) == rows(messages(spark, range(200)))
    assert table.compact() == table.manifest().version  # nothing left to do: no new version


def test_two_writers(spark, table):
    """The loser of a commit starts again from the winner's version."""
    table.append(messages(spark, range(100)))
    other, raced = KeyedTable(spark, table.base), []
    write = table._write

    def slow(m, rows_):
        done = write(m, rows_)
        if not raced:
            raced.append(other.append(messages(spark, range(500, 520))))
        return done

    table._write = slow
    table.append(messages(spark, range(100, 150)))
    assert table.manifest().version == 3
    assert rows(table.read()) == rows(messages(spark, [*range(150), *range(500, 520)]))
    with pytest.raises(ConflictError):
        table._commit(table.manifest())


def test_upsert_keeps_what_a_change_does_not_name(spark):
    users = spark.createDataFrame([(1, "a", "Moscow"), (2, "b", "Tokyo"), (3, "c", None)], "id LONG, name STRING, zone STRING")
    table = KeyedTable.create(spark, scratch_path(spark, "users"), users.schema, "id", buckets=4)
    table.replace_all(users)
    changes = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (9, "nine", 1)], "id LONG, name STRING, _version LONG")
    want = [(1, "a", "Moscow"), (2, "new", "Tokyo"), (3, "c", "UTC"), (9, "nine", "UTC")]
    for _ in range(2):
        table.upsert(changes, columns=["name"], defaults={"zone": "UTC"})
        got = {r["id"]: tuple(r) for r in table.read().collect()}
        assert got[2] == want[1] and got[9] == want[3] and got[1] == want[0] and len(got) == 4
    assert KeyedTable.create(spark, table.base, users.schema, "id").read().count() == 4  # creating again is no change
