"""ST2, K5: the mute decision (M1-M3) as a stateful stream in event-time order,
with timed expiry of mutes.

Messages may come in any order inside the watermark's delay. A user's messages
wait in state until the watermark has passed them: no earlier message can come
any more. Up to ``FEW`` of them are one value; more go to buckets of event time.
Then an event-time timer takes them out in (time, id) order and folds them, a
bucket at a time. So the result does not depend on how messages are dealt to
micro-batches, and no more than a bucket and ``FEW`` messages of a user are in
memory. The fold's own state (kept times inside the window, the
running mute) is bounded by the limit and the window.

A mute's end is a timer as well: it emits an ``unmuted`` row when the watermark
passes it, and what is left of a quiet user's state is cleared by a timer at the
time after which it can no longer change a decision.

State lives in RocksDB, which ``transformWithState`` needs; :func:`state_store`
sets the provider for the time a query starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.throttle import fold_runner, from_micros, micros
from ..schemas import MUTE_SECONDS, RATE_LIMIT, RATE_WINDOW_SECONDS
from .ingest import END_OF_INPUT

OUTPUT = "user_id LONG, flat ARRAY<LONG>"  # id, us, status, unmute_us of one row after the other
FLUSH = 10_000  # rows of a user that go out together
NO_ID = -(1 << 63)
FEW = 4096      # messages of a user that wait outside the buckets
STATUS = ["ok", "mute_start", "suppressed", "unmuted"]
_END_US = int((pd.Timestamp(END_OF_INPUT) - pd.Timestamp(0)) / pd.Timedelta(microseconds=1))
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own
    setting is put back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _frame(key, parts: list[tuple]) -> pd.DataFrame:
    """All rows of ``parts`` as one: Spark turns every frame into an Arrow
    batch of its own, which costs more for each column than for each row."""
    us, ids, status, unmute = (np.concatenate(x) for x in zip(*parts, strict=True))
    user = None if key[1] else int(key[0])
    return pd.DataFrame({"user_id": pd.array([user], "Int64"), "flat": [np.column_stack([ids, us, status, unmute]).astype(np.int64).ravel()]})


def _blob(us: np.ndarray, ids: np.ndarray) -> bytes:
    """Messages as one binary value: all times, then all ids."""
    return np.concatenate([us, ids]).astype(np.int64).tobytes()


def _messages(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(blob or b"", np.int64)
    return both[:len(both) // 2], both[len(both) // 2:]


class MuteProcessor(StatefulProcessor):
    """Per user: ``user``: the messages that came last (``few``, up to ``FEW``),
    whether others wait in ``pending``, kept times, and the end of the last
    mute while it is not passed; ``pending``: further messages by time bucket.
    Every call to the state is a round trip to the JVM, so a user of few
    messages takes one read and one write."""

    def __init__(self, limit: int, window_us: int, mute_us: int, bucket_us: int):
        self.window_us, self.mute_us, self.bucket_us = window_us, mute_us, bucket_us
        self.run = fold_runner(limit, window_us, mute_us)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "bucket LONG", "messages BINARY")
        self.user = handle.getValueState("user", "few BINARY, waiting BOOLEAN, kept BINARY, muted_until LONG")

    def _state(self) -> tuple:
        return self.user.get() or (b"", False, b"", None)

    def _by_bucket(self, us: np.ndarray, ids: np.ndarray) -> dict[int, tuple]:
        bucket = us // self.bucket_us
        return {b: (us[bucket == b], ids[bucket == b]) for b in np.unique(bucket).tolist()}

    def _put_away(self, us: np.ndarray, ids: np.ndarray) -> None:
        for b, (t, i) in self._by_bucket(us, ids).items():
            held = _messages((self.pending.getValue((b,)) or (b"",))[0])
            self.pending.updateValue((b,), (_blob(np.r_[held[0], t], np.r_[held[1], i]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        few, waiting, kept, muted = self._state()
        us, ids = _messages(few)
        first, came = None, 0
        for pdf in rows:
            new_us = pdf["us"].to_numpy().astype(np.int64)
            real = new_us < _END_US  # the end-of-input mark only moves the watermark
            if not real.any():
                continue
            new_us, new_ids = new_us[real], pdf["id"].to_numpy()[real].astype(np.int64)
            first = int(new_us.min()) if first is None else min(first, int(new_us.min()))
            us, ids, came = np.r_[us, new_us], np.r_[ids, new_ids], came + len(new_us)
            if len(us) > FEW:
                self._put_away(us, ids)
                us, ids, waiting = us[:0], ids[:0], True
        if came:  # whatever waited before has its own timer
            self.user.update((_blob(us, ids), waiting, kept, muted))
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        few, waiting, kept, muted = self._state()
        kept = np.frombuffer(kept, np.int64)
        us, ids = _messages(few)
        if waiting:
            self._put_away(us, ids)
            us, ids = us[:0], ids[:0]
            buckets = dict.fromkeys(sorted(k[0] for k in self.pending.keys()))
        else:
            buckets = self._by_bucket(us, ids)
        due = [b * self.bucket_us for b in buckets if b * self.bucket_us > passed][:1]
        left: list[tuple] = [m for b, m in buckets.items() if b * self.bucket_us > passed and not waiting]
        out: list[tuple] = []  # (us, ids, status, unmute); ids of ends of mutes are not read
        held = 0
        remain = waiting and bool(due)  # messages are left in ``pending``

        def ended(unmute: np.ndarray) -> None:
            if len(unmute):
                out.append((unmute, unmute, np.full(len(unmute), 3), unmute))

        for b in [b for b in buckets if b * self.bucket_us <= passed]:
            us, ids = _messages(self.pending.getValue((b,))[0]) if waiting else buckets[b]
            order = np.lexsort((ids, us))
            us, ids = us[order], ids[order]
            n = int(np.searchsorted(us, passed, "right"))
            if n < len(us):
                due.append(int(us[n]))
                if waiting:
                    self.pending.updateValue((b,), (_blob(us[n:], ids[n:]),))
                    remain = True
                else:
                    left.append((us[n:], ids[n:]))
            elif waiting:
                self.pending.removeKey((b,))
            if not n:
                continue
            status, unmute = np.zeros(n, np.int8), np.full(n, -1, np.int64)
            before = muted
            kept, muted = self.run(us[:n], kept, muted, status, unmute)
            out.append((us[:n], ids[:n], status, unmute))
            # Every mute that another one follows has ended.
            starts = unmute[unmute >= 0]
            if len(starts):
                ended(np.r_[[] if before is None else [before], starts[:-1]].astype(np.int64))
            held += n
            if held > FLUSH:
                yield _frame(key, out)
                out, held = [], 0
        if muted is not None and muted <= passed:
            ended(np.array([muted], np.int64))
            muted = None
        quiet = int(kept[-1]) + self.window_us + 1000 if len(kept) else 0
        forgotten = muted is None and quiet <= passed
        if forgotten:
            kept = kept[:0]
        else:
            due.append(quiet if muted is None else muted)
        if due:  # the next message, the end of the mute or of the window
            rest = [np.concatenate(x) for x in zip(*left, strict=True)] or [us[:0], ids[:0]]
            self.user.update((_blob(*rest), remain, kept.tobytes(), muted))
            self.handle.registerTimer(max(min(due), passed) // 1000)
        else:
            self.user.clear()
        if out:
            yield _frame(key, out)

    def close(self) -> None:
        pass


def throttle_events(msgs: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS,
                    mute_seconds: int = MUTE_SECONDS, watermark: str = "1 minute", bucket_seconds: int | None = None) -> DataFrame:
    """Decisions and ends of mutes: user_id, id, timestamp, status (``ok``,
    ``mute_start``, ``suppressed``, ``unmuted``), unmute_time. An ``unmuted`` row
    has no id; its timestamp is the mute's end."""
    processor = MuteProcessor(limit, window_seconds * 1_000_000, mute_seconds * 1_000_000,
                              (bucket_seconds or 8 * max(1, window_seconds)) * 1_000_000)
    # Watermarks need TIMESTAMP (instants); the tables hold UTC wall time.
    prepared = (msgs.withColumn("_event_time", F.col("timestamp").cast("timestamp"))
                .withWatermark("_event_time", watermark)
                # Without nulls: pandas would make all ids of a batch that holds one floating-point numbers.
                .select(F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), F.col("user_id").isNull().alias("no_user"),
                        F.coalesce("id", F.lit(NO_ID)).cast("long").alias("id"), micros("timestamp").alias("us"), "_event_time"))
    out = prepared.groupBy("user_id", "no_user").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
    names = ", ".join(f"'{x}'" for x in STATUS)
    out = out.selectExpr("user_id", f"""inline(transform(sequence(0, size(flat) - 4, 4), i -> named_struct(
        'id', flat[i], 'us', flat[i + 1], 'status', array({names})[cast(flat[i + 2] AS INT)], 'unmute_us', flat[i + 3])))""")
    return out.select("user_id", F.when((F.col("status") != "unmuted") & (F.col("id") != NO_ID), F.col("id")).alias("id"), from_micros("us").alias("timestamp"),
                      "status", F.when(F.col("unmute_us") >= 0, from_micros("unmute_us")).alias("unmute_time"))


def throttle_stream(msgs: DataFrame, *args, **options) -> DataFrame:
    """The decisions of :func:`throttle_events`: one row per message, as ``mute_fold``."""
    return throttle_events(msgs, *args, **options).where("status <> 'unmuted'")


def expired_mutes(events: DataFrame, mute_seconds: int = MUTE_SECONDS) -> DataFrame:
    """K5: (user_id, mute_time, unmute_time) of the mutes that have ended."""
    ended = events.where("status = 'unmuted'")
    return ended.select("user_id", (F.col("unmute_time") - F.expr(f"make_dt_interval(0, 0, 0, {mute_seconds})")).alias("mute_time"), "unmute_time")
