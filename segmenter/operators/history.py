"""Message history pages with local time and grouping.

Paging uses ``row_number`` per user filtered to the page; Catalyst turns the
``rn <= (page+1)*size`` bound into a partial per-partition WindowGroupLimit
before the shuffle, so a user with millions of messages sends only the first
rows of each map partition. Totals per user are a partial aggregation.
Full newest-first positions (no page bound) use ``rank.rank_table``, which
splits heavy users across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import period_key
from ..functions.text import wrap_fixed
from ..schemas import DEFAULT_TIMEZONE, PAGE_SIZE, WRAP_WIDTH
from .rank import rank_table


def with_user_zone(msgs: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """The user's zone and flag, Europe/Moscow / false for unknown users.
    A left join on the user key; Spark broadcasts the users side only when its
    measured size is under the broadcast threshold."""
    u = users.select(F.col("id").alias("_uid"), F.col("timezone").alias("_tz"),
                     F.col("timezone_set").alias("_tz_set"))
    j = msgs.join(u, F.col(user_col) == F.col("_uid"), "left")
    return (j.withColumn("timezone", F.coalesce(F.col("_tz"), F.lit(DEFAULT_TIMEZONE)))
            .withColumn("timezone_set", F.coalesce(F.col("_tz_set"), F.lit(False)))
            .drop("_uid", "_tz", "_tz_set"))


def local_time(ts: Column, zone: Column) -> Column:
    """UTC wall time -> wall time in ``zone`` (per row)."""
    return F.convert_timezone(F.lit("UTC"), zone, ts.cast("timestamp_ntz"))


def history_of(msgs: DataFrame, user_id: int, user_col: str = "user_id", ts: str = "timestamp",
               id_col: str = "id") -> DataFrame:
    """S10 + T1: one user's messages, newest first. The equality filter reaches
    the Parquet scan as a pushed filter."""
    return msgs.where(F.col(user_col) == F.lit(user_id)).orderBy(F.col(ts).desc(), F.col(id_col).desc())


def newest_first_positions(msgs: DataFrame, user_col: str = "user_id", ts: str = "timestamp",
                           id_col: str = "id") -> DataFrame:
    """1-based newest-first position of every message inside its user
    (ties on time broken by id, newest id first). Messages without a user are
    ranked together, as one user's."""
    return rank_table(msgs, [F.col(ts).desc(), F.col(id_col).desc()], group=user_col, rank_col="rn").df


def history_page(msgs: DataFrame, page: int = 0, page_size: int = PAGE_SIZE, user_col: str = "user_id",
                 ts: str = "timestamp", id_col: str = "id") -> DataFrame:
    """T2 + A6: rows of ``page`` (zero-based) per user, newest first, with the
    user's total, page count and has_prev / has_next flags."""
    w = Window.partitionBy(user_col).orderBy(F.col(ts).desc(), F.col(id_col).desc())
    lo, hi = page * page_size, (page + 1) * page_size
    rows = (msgs.withColumn("rn", F.row_number().over(w))
            .where((F.col("rn") <= hi) & (F.col("rn") > lo)))
    totals = msgs.groupBy(user_col).agg(F.count(F.lit(1)).alias("total"))
    return (rows.join(totals, user_col)
            .withColumn("pages", ((F.col("total") - 1) / page_size).cast("long") + 1)
            .withColumn("has_prev", F.lit(page > 0))
            .withColumn("has_next", F.least(F.lit(hi), F.col("total")) < F.col("total")))


def history_page_deep(msgs: DataFrame, page: int, page_size: int = PAGE_SIZE, user_col: str = "user_id", ts: str = "timestamp",
                      id_col: str = "id", bucket_seconds: int = 3600) -> DataFrame:
    """T2 far back: rows of ``page`` per user with ``rn`` and ``total``.

    Row counts per user and time bucket say which buckets hold the page; only
    their rows are ranked, after the rows of newer buckets. ``history_page``
    sends up to (page + 1) * page_size rows per user from every task; this sends
    the counts and the rows of one or two buckets per user."""
    lo, hi = page * page_size, (page + 1) * page_size
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (bucket_seconds * 1_000_000))
    counts = msgs.groupBy(F.col(user_col).alias("_u"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    user = Window.partitionBy("_u")
    newer = F.coalesce(F.sum("_n").over(user.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = (counts.withColumn("_newer", newer).withColumn("total", F.sum("_n").over(user))
              .where((F.col("_newer") < hi) & (F.col("_newer") + F.col("_n") > lo)).drop("_n"))
    rows = msgs.withColumn("_bucket", bucket)
    rows = rows.join(wanted, F.col(user_col).eqNullSafe(F.col("_u")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    inside = Window.partitionBy(user_col, "_bucket").orderBy(F.col(ts).desc(), F.col(id_col).desc())
    return (rows.withColumn("rn", F.col("_newer") + F.row_number().over(inside)).where((F.col("rn") > lo) & (F.col("rn") <= hi))
            .drop("_u", "_b", "_bucket", "_newer"))


# Title of a history page.
HISTORY_TITLE = {"ru": "📜 История переписки:", "en": "📜 Chat history:"}


def page_text(rendered: DataFrame, page: int = 0, lang: str = "en", user_col: str = "user_id") -> DataFrame:
    """A page as one text per user: title, page number, headers and lines.
    A page is at most ``page_size`` lines, so the per-user list is bounded.
    Expects the columns of :func:`render_lines` and ``pages``."""
    line = F.concat(F.coalesce(F.concat(F.col("header"), F.lit("\n\n")), F.lit("")), F.col("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("text")))), lambda x: x["text"])
    title = F.concat(F.lit(f"{HISTORY_TITLE[lang]} (Страница {page + 1} из "), F.max("pages").cast("string"), F.lit(")\n\n"))
    return rendered.groupBy(user_col).agg(F.concat(title, F.array_join(lines, "\n\n")).alias("text"))


def render_lines(page_rows: DataFrame, period: str | None = None, lang: str = "en",
                 user_col: str = "user_id", width: int = WRAP_WIDTH) -> DataFrame:
    """Local time text, wrapped message, period key and a header
    when the key changes from the previous row of the same page.
    Expects ``local_ts``, ``message`` and ``rn`` columns."""
    key = period_key(F.col("local_ts"), period, lang)
    prev = F.lag(key).over(Window.partitionBy(user_col).orderBy("rn"))
    line = F.concat(F.date_format("local_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("\n"),
                    wrap_fixed(F.col("message"), width))
    header = F.when(key.isNotNull() & ~key.eqNullSafe(prev), F.concat(F.lit("\n<b>"), key, F.lit("</b>")))
    return page_rows.withColumn("period_key", key).withColumn("header", header).withColumn("line", line)
