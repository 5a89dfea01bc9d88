"""Trailing message counts, mutes and the spam decision.

W4 (trailing count) is a range-frame window, but not partitioned by user
alone: time is cut into buckets of ``bucket_seconds`` (>= the window) and each
row is also copied, as a non-counted halo row, into the next bucket when it
lies within one window of that bucket's start. A window per (user, bucket)
then sees everything it needs, so a user with a third of all messages is
spread over as many tasks as that user has buckets. Exact.

M1 (mute decision) is recursive -- suppressed messages do not count later --
so it is a fold along a user's messages. Messages are range-partitioned on
(user, time, id) and checkpointed with their partitions kept, so a heavy user
spans many partitions, and each partition is folded where it lies. Only the
first user of a partition may come with a state from the left. All partitions
are first folded at once from a guess, an empty state. Then every partition
whose guess differs from what its left neighbour ends with is repaired, again
all at once: the old and the new state are run side by side until both agree,
after which the partition's end stays as it was. They agree as soon as no mute
is alive in either and one window has passed (so at once for users under the
limit), or when both meet in the same mute. This goes on until nothing changes;
each round settles at least one more partition of a chain, so the result is
that of the sequential fold. What the driver holds is one bounded state (the
messages kept inside a window) per partition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MUTE_SECONDS, RATE_LIMIT, RATE_WINDOW_SECONDS
from ..session import checkpoint_partitions, partitions_for

_US = 1_000_000


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: str):
    """Microseconds since the epoch of a UTC wall-clock timestamp; does not
    depend on the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, CAST(`{ts}` AS TIMESTAMP_NTZ))")


def from_micros(c: str):
    return F.expr(f"timestampadd(MICROSECOND, `{c}`, {_EPOCH})")


def trailing_count(msgs: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, user_col: str = "user_id",
                   ts_col: str = "timestamp", out_col: str = "recent",
                   bucket_seconds: int | None = None) -> DataFrame:
    """Messages of the same user with time in [t - window, t] (inclusive,
    equal times included), for every message."""
    w_us = int(window_seconds * _US)
    # Buckets of 8 windows: one row in eight is copied as a halo at most.
    b_us = int(max(bucket_seconds or 8 * window_seconds, window_seconds) * _US)
    us = micros(ts_col)
    own_b = ((us - F.pmod(us, F.lit(b_us))) / F.lit(b_us)).cast("long")  # exact floor division
    buckets = F.when(us >= (own_b + 1) * b_us - w_us, F.array(own_b, own_b + 1)).otherwise(F.array(own_b))
    exploded = (msgs.withColumn("_us", us).withColumn("_own", own_b)
                .withColumn("_b", F.explode(buckets)))
    w = Window.partitionBy(user_col, "_b").orderBy("_us").rangeBetween(-w_us, 0)
    return (exploded.withColumn(out_col, F.count(F.lit(1)).over(w))
            .where(F.col("_b") == F.col("_own"))
            .drop("_us", "_own", "_b"))


def over_limit(msgs: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS,
               **kw) -> DataFrame:
    """M4: messages whose trailing count (itself included) exceeds ``limit``,
    ignoring the feedback of mutes."""
    return trailing_count(msgs, window_seconds, **kw).where(F.col("recent") > limit)


# --- fold over range partitions ---------------------------------------------------

def fold_runner(limit: int, w_us: int, m_us: int):
    """Build the fold step (a closure, shipped to workers by value).

    ``fold_run(t, kept, muted_until, status, unmute)`` folds one run of sorted
    times ``t`` (numpy int64) of one key from state (kept times, mute end),
    writing status codes (0 ok, 1 mute_start, 2 suppressed) and mute ends into
    the given arrays, and returns the new state. A plain loop over the run: a
    few comparisons per row, and cheaper than numpy-vectorised variants that
    were measured (per-call overhead dominates when mutes are frequent).
    """

    def fold_run(t, kept, muted_until, status, unmute):
        kept = kept.tolist() if hasattr(kept, "tolist") else list(kept)
        first = 0
        for j, tj in enumerate(t.tolist()):
            if muted_until is not None and tj < muted_until:
                status[j] = 2
                continue
            kept.append(tj)
            edge = tj - w_us
            while kept[first] < edge:
                first += 1
            if first > 4096:
                kept, first = kept[first:], 0
            if len(kept) - first > limit:
                status[j] = 1
                muted_until = tj + m_us
                unmute[j] = muted_until
        return np.array(kept[first:], dtype=np.int64), muted_until

    return fold_run


def _batch(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(user, whether it is null, time) of an Arrow batch."""
    u = batch.column("u")
    return u.fill_null(0).to_numpy(), np.asarray(u.is_null()), batch.column("us").to_numpy()


def _run_starts(u: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (null[1:] != null[:-1])])


def _key(u: np.ndarray, null: np.ndarray, i: int) -> tuple[bool, int]:
    return bool(null[i]), int(u[i])


State = tuple[tuple[int, ...], int | None]  # kept times, end of the mute
EMPTY: State = ((), None)


def canonical(kept, muted_until: int | None, now: int, w_us: int) -> State:
    """The part of a state that can matter to messages at ``now`` or later."""
    return tuple(int(x) for x in kept if x >= now - w_us), (None if muted_until is None or muted_until <= now else int(muted_until))


@dataclass
class Piece:
    """A partition as the driver knows it: its first and last user, the first
    time, the state it was folded from and the one it ends with."""
    first: tuple[bool, int]
    last: tuple[bool, int]
    start: int
    entry: State
    exit: State


@dataclass(frozen=True)
class Fold:
    """Limit, window and mute of a mute decision, and the passes over partitions."""
    limit: int
    w_us: int
    m_us: int

    def _step(self, times: np.ndarray, state: State) -> State:
        n = len(times)
        kept, muted = fold_runner(self.limit, self.w_us, self.m_us)(
            times, list(state[0]), state[1], np.zeros(n, np.int8), np.zeros(n, np.int64))
        return canonical(kept, muted, int(times[-1]), self.w_us)

    def exits(self):
        """Per partition: its ends and the state after its last user, from an empty one."""
        def run(batches):
            import pyarrow as pa

            pid = first = last = start = None
            state = EMPTY
            for batch in batches:
                if not batch.num_rows:
                    continue
                u, null, us = _batch(batch)
                if first is None:
                    pid, first, start = batch.column("_pid")[0].as_py(), _key(u, null, 0), int(us[0])
                a = int(_run_starts(u, null)[-1])  # earlier users end here
                if a or _key(u, null, 0) != last:
                    state = EMPTY
                last = _key(u, null, a)
                state = self._step(us[a:], state)
            if first is not None:
                yield pa.RecordBatch.from_pylist([{
                    "_pid": pid, "first_null": first[0], "first": first[1], "last_null": last[0], "last": last[1], "start": start,
                    "kept": list(state[0]), "muted": state[1]}], schema=_EXITS())
        return run

    def repairs(self, sent):
        """For partitions in ``sent`` ({pid: (old entry, new entry)}): whether
        the two never agree up to the end, and the end state from the new one."""
        def run(batches):
            import pyarrow as pa

            pid = user = None
            old = new = EMPTY
            for batch in batches:
                if not batch.num_rows:
                    continue
                u, null, us = _batch(batch)
                if pid is None:
                    pid = batch.column("_pid")[0].as_py()
                    if pid not in sent.value:
                        return
                    (old, new), user = sent.value[pid], _key(u, null, 0)
                if _key(u, null, 0) != user:
                    return
                starts = _run_starts(u, null)
                end = int(starts[1]) if len(starts) > 1 else len(us)
                for a in range(0, end, 1024):
                    b = min(end, a + 1024)
                    old, new = self._step(us[a:b], old), self._step(us[a:b], new)
                    if old == new:
                        return
                if end < len(us):
                    return
            if pid is not None:
                yield pa.RecordBatch.from_pylist([{"_pid": pid, "kept": list(new[0]), "muted": new[1]}], schema=_REPAIRS())
        return run

    def decisions(self, sent):
        """Status codes and mute ends of all rows, partitions entered by ``sent`` ({pid: state})."""
        fold = fold_runner(self.limit, self.w_us, self.m_us)

        def run(batches):
            import pyarrow as pa

            key, kept, muted = None, [], None
            names = np.array(["ok", "mute_start", "suppressed"], dtype=object)
            for batch in batches:
                if not batch.num_rows:
                    continue
                u, null, us = _batch(batch)
                if key is None:
                    key = _key(u, null, 0)
                    kept, muted = sent.value.get(batch.column("_pid")[0].as_py(), EMPTY)
                status, unmute = np.zeros(len(us), np.int8), np.full(len(us), -1, np.int64)
                bounds = [*_run_starts(u, null).tolist(), len(us)]
                for a, b in zip(bounds, bounds[1:]):
                    if _key(u, null, a) != key:
                        key, kept, muted = _key(u, null, a), [], None
                    kept, muted = fold(us[a:b], kept, muted, status[a:b], unmute[a:b])
                yield pa.RecordBatch.from_pydict({
                    "u": batch.column("u"), "i": batch.column("i"), "us": batch.column("us"),
                    "status": pa.array(names[status], pa.string()), "unmute_us": pa.array(unmute, mask=unmute < 0)})
        return run


def _REPAIRS():
    import pyarrow as pa

    return pa.schema([("_pid", pa.int32()), ("kept", pa.list_(pa.int64())), ("muted", pa.int64())])


def _EXITS():
    import pyarrow as pa

    return pa.schema([("_pid", pa.int32()), ("first_null", pa.bool_()), ("first", pa.int64()), ("last_null", pa.bool_()), ("last", pa.int64()),
                      ("start", pa.int64()), ("kept", pa.list_(pa.int64())), ("muted", pa.int64())])


def entry_states(ordered: DataFrame, fold: Fold) -> tuple[dict[int, State], int]:
    """({pid: state that its first user comes with}, rounds of repair)."""
    spark = ordered.sparkSession
    ends = ordered.mapInArrow(fold.exits(), "_pid INT, first_null BOOLEAN, first LONG, last_null BOOLEAN, last LONG, start LONG, "
                                            "kept ARRAY<LONG>, muted LONG").collect()
    pieces = {r["_pid"]: Piece((r["first_null"], r["first"]), (r["last_null"], r["last"]), r["start"], EMPTY, (tuple(r["kept"]), r["muted"]))
              for r in sorted(ends, key=lambda r: r["_pid"])}
    chain = list(pieces.values())
    rounds = 0
    while True:
        todo: dict[int, tuple[State, State]] = {}
        for (pid, p), left in zip(list(pieces.items())[1:], chain):
            entry = canonical(*left.exit, p.start, fold.w_us) if left.last == p.first else EMPTY
            if entry != p.entry:
                todo[pid] = (p.entry, entry)
        if not todo:
            return {pid: p.entry for pid, p in pieces.items() if p.entry != EMPTY}, rounds
        rounds += 1
        sent = spark.sparkContext.broadcast(todo)
        for r in ordered.mapInArrow(fold.repairs(sent), "_pid INT, kept ARRAY<LONG>, muted LONG").collect():
            pieces[r["_pid"]].exit = (tuple(r["kept"]), r["muted"])
        for pid, (_, entry) in todo.items():
            pieces[pid].entry = entry


def ordered_messages(msgs: DataFrame, user_col: str = "user_id", ts_col: str = "timestamp", id_col: str = "id",
                     num_partitions: int | None = None) -> DataFrame:
    """(u, us, i, _pid) in order over checkpointed range partitions."""
    base = msgs.select(F.col(user_col).cast("long").alias("u"), micros(ts_col).alias("us"), F.col(id_col).cast("long").alias("i"))
    keys = ["u", "us", "i"]
    return checkpoint_partitions(base.repartitionByRange(num_partitions or partitions_for(base), *keys)
                                 .sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()))


def mute_fold(msgs: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS,
              mute_seconds: int = MUTE_SECONDS, user_col: str = "user_id", ts_col: str = "timestamp",
              id_col: str = "id", counts_towards_limit: Column | None = None, num_partitions: int | None = None) -> DataFrame:
    """M1-M3: status of every message in time order per user.

    ``ok``: saved and counted; ``mute_start``: saved, counted, and the trailing
    count (itself included, window inclusive) exceeded ``limit``, which mutes
    the user for [t, t + mute); ``suppressed``: arrived while muted (t < unmute
    time), neither saved nor counted. Output: user_id, id, timestamp, status,
    unmute_time (set on ``mute_start`` rows).

    ``counts_towards_limit``: messages for which it is not true (replies of the
    bot, uploads) are saved whatever happens, ``ok``, and not counted. So are
    messages without a time. Messages without a user are folded together.
    """
    fold = Fold(limit, int(window_seconds * _US), int(mute_seconds * _US))
    judged = F.col(ts_col).isNotNull() & (F.lit(True) if counts_towards_limit is None else F.coalesce(counts_towards_limit, F.lit(False)))
    ordered = ordered_messages(msgs.where(judged), user_col, ts_col, id_col, num_partitions)
    entries, _ = entry_states(ordered, fold)
    sent = msgs.sparkSession.sparkContext.broadcast(entries)
    out = ordered.mapInArrow(fold.decisions(sent), "u LONG, i LONG, us LONG, status STRING, unmute_us LONG")
    out = out.select(F.col("u").alias(user_col), F.col("i").alias(id_col), from_micros("us").alias(ts_col), "status",
                     from_micros("unmute_us").alias("unmute_time"))
    others = msgs.where(~judged).select(F.col(user_col).cast("long").alias(user_col), F.col(id_col).cast("long").alias(id_col),
                                        F.col(ts_col).cast("timestamp_ntz").alias(ts_col), F.lit("ok").alias("status"),
                                        F.lit(None).cast("timestamp_ntz").alias("unmute_time"))
    return out.unionByName(others)


def mute_intervals(folded: DataFrame, user_col: str = "user_id", ts_col: str = "timestamp") -> DataFrame:
    """M2: (user_id, mute_time, unmute_time) per mute."""
    return folded.where(F.col("status") == "mute_start").select(
        user_col, F.col(ts_col).alias("mute_time"), "unmute_time")


def active_mutes(mutes: DataFrame, as_of) -> DataFrame:
    """M3 / K5: mutes still running at ``as_of`` (expired ones removed)."""
    t = F.lit(str(as_of)).cast("timestamp_ntz")
    return mutes.where(F.col("unmute_time") >= t)
