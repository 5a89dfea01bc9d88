"""Stream = batch on the same finite input, over several micro-batches out of order."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from conftest import SF_MID
from segmenter.operators.throttle import mute_fold, mute_intervals
from segmenter.sources.tables import table
from segmenter.streaming.ingest import as_messages, ingest, run_to_end, until_end
from segmenter.streaming.last_seen import last_seen_stream, read_table
from segmenter.streaming.throttle import expired_mutes, state_store, throttle_events


def jittered_files(spark, n=4):
    """A few users' events, one of them null and one with half the rows, as n
    files; messages come up to a day late, so files overlap in time."""
    d = tempfile.mkdtemp(prefix="segmenter-stream-")
    e = table(spark, SF_MID, "events").where("event_id % 4 = 0")
    e = e.withColumn("user_id", F.when(F.col("event_id") % 8 == 0, 7).when(F.col("event_id") % 12 == 4, None).otherwise(F.col("user_id") % 12))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    late = e.withColumn("us", us + F.pmod(F.xxhash64("event_id"), F.lit(86_400_000_000)))
    lo, hi = late.agg(F.min("us"), F.max("us")).first()
    dealt = late.withColumn("f", F.least(F.floor((F.col("us") - lo) / ((hi - lo) / n)), F.lit(n - 1))).drop("us").persist()
    for f in range(n):
        dealt.where(F.col("f") == f).drop("f").orderBy(F.xxhash64("event_id", F.lit(1))).coalesce(1).write.mode("append").parquet(d)
    dealt.unpersist()
    return d, e


def test_throttle_stream_in_any_order_equals_the_fold(spark):
    src, e = jittered_files(spark)
    base = tempfile.mkdtemp(prefix="segmenter-stream-out-")
    stream = as_messages(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src))
    out = throttle_events(until_end(stream, f"{base}/marks"), 3, 86400, 86400, watermark="2 days", bucket_seconds=7200)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with state_store(spark):
        run_to_end(out, f"{base}/throttle", f"{base}/ck1", stream.schema, f"{base}/marks")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = spark.read.parquet(f"{base}/throttle")
    exp = mute_fold(as_messages(e), 3, 86400, 86400)

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    assert rows(got.where("status <> 'unmuted'").select(exp.columns)) == rows(exp)
    # Every mute ended, and was reported once.
    assert rows(expired_mutes(got, 86400)) == rows(mute_intervals(exp).select("user_id", "mute_time", "unmute_time"))


def test_mutes_end_and_messages_wait_with_the_watermark(spark):
    """Without an end-of-input mark only what the watermark has passed comes out."""
    src, e = jittered_files(spark)
    base = tempfile.mkdtemp(prefix="segmenter-stream-out-")
    stream = as_messages(spark.readStream.schema(e.schema).parquet(src))
    with state_store(spark):
        ingest(throttle_events(stream, 3, 86400, 86400, watermark="10 days"), f"{base}/throttle", f"{base}/ck").awaitTermination()
    got = spark.read.parquet(f"{base}/throttle")
    passed = e.agg(F.max("ts")).first()[0] - dt.timedelta(days=10)
    exp = mute_fold(as_messages(e), 3, 86400, 86400)
    assert got.where("status <> 'unmuted'").count() == e.where(F.col("ts") < F.lit(passed)).count()
    ended = {(r["user_id"], r["unmute_time"]) for r in got.where("status = 'unmuted'").collect()}
    assert ended == {(r["user_id"], r["unmute_time"]) for r in mute_intervals(exp).collect() if r["unmute_time"] <= passed}


def test_busy_users_and_no_user_in_one_partition(spark):
    """A user of more messages than wait in one value, next to small users and messages without a user."""
    src, base = (tempfile.mkdtemp(prefix="segmenter-stream-") for _ in range(2))
    n = spark.range(12_000).withColumnRenamed("id", "event_id")
    e = n.select("event_id", F.expr("timestamp_seconds(1704067200 + (event_id * 7919) % 1000003)").cast("timestamp_ntz").alias("ts"),
                 F.expr("if(event_id < 9000, 1, if(event_id % 40 = 3, null, event_id % 40 + 2))").cast("long").alias("user_id"),
                 F.lit("a").alias("event_type"), F.lit("b").alias("props"))
    e.coalesce(1).write.mode("append").parquet(src)
    e = spark.read.parquet(src)
    stream = as_messages(spark.readStream.schema(e.schema).parquet(src))
    exp = sorted((tuple(r) for r in mute_fold(as_messages(e), 3, 3600, 7200).collect()), key=str)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for at_once in (False, True):
            marks, sink = f"{base}/marks{at_once}", f"{base}/out{at_once}"
            out = throttle_events(until_end(stream, marks), 3, 3600, 7200, watermark="2 days")
            with state_store(spark):
                run_to_end(out, sink, f"{base}/ck{at_once}", stream.schema, marks, at_once)
            got = spark.read.parquet(sink)
            cols = mute_fold(as_messages(e), 3, 3600, 7200).columns
            assert sorted((tuple(r) for r in got.where("status <> 'unmuted'").select(cols).collect()), key=str) == exp
            ended = expired_mutes(got, 7200)
            assert sorted(map(str, ended.collect())) == sorted(map(str, mute_intervals(mute_fold(as_messages(e), 3, 3600, 7200))
                                                                   .select("user_id", "mute_time", "unmute_time").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_last_seen_stream_equals_batch(spark):
    src, e = jittered_files(spark)
    base = tempfile.mkdtemp(prefix="segmenter-stream-out-")
    stream2 = as_messages(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src))
    last_seen_stream(stream2, f"{base}/last", f"{base}/ck2").awaitTermination()
    got2 = {r["user_id"]: r["last_time"] for r in read_table(spark, f"{base}/last").collect()}
    exp2 = {r["user_id"]: r["m"] for r in as_messages(e).groupBy("user_id").agg(F.max("timestamp").alias("m")).collect()}
    assert got2 == exp2
