"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boldify, normalize_id, parse_date, period_key, recency_days, text_to_number, wrap_fixed
from ..operators import history as H
from ..operators import knn as K
from ..operators import throttle as TH
from ..operators.chunk import chunk_text
from ..operators.columns import project_canonical
from ..sources import csv_scan as CS
from ..operators import summary as S
from ..operators.clean import clamp_negative, clean_customers, fill_median, typed_frame
from ..operators.rank import with_global_rank
from ..operators.score import bins_probs
from ..schemas import SEGMENTS
from ..operators.selection import exact_quantiles_many
from ..sources import tables as T
from . import sql as Q
from .rfm import analyze

Query = Callable[[SparkSession, str], DataFrame]


# --- scoring -----------------------------------------------------------------

def rfm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8 flagship: per-customer scores and segment from the orders metrics."""
    return analyze(T.customer_metrics(spark, sf_dir, T.AS_OF), as_of=T.AS_OF).scored


def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: five rows, fixed order, zero-filled."""
    return analyze(T.customer_metrics(spark, sf_dir, T.AS_OF), as_of=T.AS_OF).summary


def score_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: recency clamped to many zeros repeats edges -> fallback route."""
    return analyze(T.customer_metrics(spark, sf_dir, T.AS_OF_TIED), as_of=T.AS_OF_TIED).scored


def score_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 on heavily tied per-order measures from lineitem."""
    return analyze(T.tied_metrics(spark, sf_dir)).scored


def score_few_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5 + Q7: measures of 2, 3 and 4 different values are scored with as many bins."""
    o = T.table(spark, sf_dir, "orders")
    out = None
    for k in (2, 3, 4):
        value = (F.col("o_orderkey") % k).cast("double")
        m = o.select(F.concat(F.lit("C"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("client_id"), value.alias("recency"),
                     (value * 10).alias("amount"), value.alias("frequency"))
        scored = analyze(m).scored.select(F.lit(k).alias("bins"), "Buyer", "R_Score", "F_Score", "M_Score", "Segment")
        out = scored if out is None else out.unionByName(scored)
    return out


def f_score_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3 on one row per purchase without a frequency: how many rows of each
    buyer got each F score (rows of one id are ranked one by one)."""
    o = T.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("1"), F.col("o_custkey").cast("string")).alias("client_id"),
        F.col("o_orderkey").cast("double").alias("recency"), F.col("o_totalprice").cast("double").alias("amount"))
    return analyze(o).scored.groupBy("Buyer", "F_Score").agg(F.count(F.lit(1)).alias("n"))


# --- cleaning on the dirty customer table -------------------------------------

def _dirty(spark, sf_dir):
    return T.dirty_customers(spark, sf_dir)


def normalize_id_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 on every customer id."""
    d = _dirty(spark, sf_dir)
    return d.select("row_key", F.col("client_id").alias("raw_id"),
                    normalize_id(F.col("client_id")).alias("client_id"))


def text_to_number_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 on amounts and frequencies written as text, words and NA tokens."""
    d = _dirty(spark, sf_dir)
    return d.select("row_key", F.col("amount").alias("raw_amount"), text_to_number("amount").alias("amount"),
                    F.col("frequency").alias("raw_frequency"), text_to_number("frequency").alias("frequency"))


def parse_dates_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 + C4: three layouts and junk -> timestamp, days to as_of."""
    d = _dirty(spark, sf_dir)
    parsed = parse_date("date")
    return d.select("row_key", F.col("date").alias("raw_date"), parsed.alias("date"),
                    recency_days(parsed, T.AS_OF).alias("recency"))


def parse_date_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in eight layouts, day-first slashes among them."""
    o = T.table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    layouts = ["yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MM/dd/yy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss"]
    raw = F.date_format(d, layouts[0])
    for i, layout in enumerate(layouts[1:], 1):
        raw = F.when(F.col("o_orderkey") % len(layouts) == i, F.date_format(d, layout)).otherwise(raw)
    return o.select("o_orderkey", raw.alias("raw_date"), parse_date(raw).alias("date"))


def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region, a map of nation labels in which every third is missing or
    null, filled up from the default map."""
    n = T.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    labels = n.groupBy("n_regionkey").agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.col("n_name")))).alias("default"),
        F.map_from_entries(F.collect_list(F.when(key % 3 != 0, F.struct(key, F.when(key % 3 == 1, F.upper("n_name")))))).alias("local"))
    return labels.select("n_regionkey", F.explode(S.labels_with_fallback(F.col("local"), F.col("default"))).alias("n_nationkey", "label"))


def _cleaned(spark, sf_dir):
    return clean_customers(_dirty(spark, sf_dir), as_of=T.AS_OF, passthrough=("row_key",))


def impute_median_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps -> exact median of the kept rows (before clamping)."""
    typed = typed_frame(_dirty(spark, sf_dir), T.AS_OF, passthrough=("row_key",))
    kept = typed.where(F.col("client_id").isNotNull() & F.col("date").isNotNull())
    return fill_median(kept.select("row_key", "amount", "frequency"), ["amount", "frequency"])


def clean_customers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 + C1-C6: drop missing ids and bad dates, fill, clamp."""
    return _cleaned(spark, sf_dir).df


def quality_report_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per rule and column."""
    return _cleaned(spark, sf_dir).report(spark)


def rfm_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8 on the dirty table: clean, score, segment."""
    return analyze(_dirty(spark, sf_dir).drop("row_key"), as_of=T.AS_OF).scored


# --- report, dominant segment, statistics -----------------------------------

def _summary(spark, sf_dir):
    return segment_summary(spark, sf_dir)


def segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report text."""
    return S.report_text(_summary(spark, sf_dir))


def extract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts parsed back from the report text."""
    return S.extract_counts(S.report_text(_summary(spark, sf_dir)))


def dominant_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: most customers, ties to the first in the fixed order."""
    return S.dominant_segment(_summary(spark, sf_dir))


def _rfm_base(spark, sf_dir):
    from .rfm import to_rfm_frame
    return to_rfm_frame(clean_customers(T.customer_metrics(spark, sf_dir, T.AS_OF), as_of=T.AS_OF).df)


def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: exact quintile edges of the three measures, by selection."""
    base = _rfm_base(spark, sf_dir)
    cols = ["Recency", "Monetary", "Frequency"]
    edges = exact_quantiles_many(base, {c: bins_probs(5) for c in cols})
    rows = [(c, i, round(float(e), 6)) for c in cols for i, e in enumerate(edges[c] or [])]
    return spark.createDataFrame(rows, "measure STRING, edge_no INT, edge DOUBLE")


def rank_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: global first-come rank by (Frequency, Buyer) without a single-task window."""
    base = _rfm_base(spark, sf_dir).select("Buyer", "Frequency")
    return with_global_rank(base, ["Frequency", "Buyer"], rank_col="rank")


# --- similarity ---------------------------------------------------------------

def _knn(spark, sf_dir, keys, **kw):
    reqs = T.requests_from_embeddings(spark, sf_dir)
    hits = K.knn_join(reqs, T.corpus(spark, sf_dir), keys, k=3, **kw)
    return hits.withColumn("distance", F.round("distance", 6))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1/V3: top 3 per request among its language and segment."""
    return _knn(spark, sf_dir, ["language", "segment"])


def knn_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2/V3: top 3 per request among its language, all segments."""
    return _knn(spark, sf_dir, ["language"])


def knn_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 beyond the broadcast bound: corpus blocks and requests meet in a sort-based
    co-group on (language, block); per-request merge of the block top-k lists."""
    return _knn(spark, sf_dir, ["language"], force_blocked=True, block_rows=64)


def knn_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request (the mean of all vectors, computed by Spark), English
    corpus, ORDER BY distance LIMIT 3."""
    corpus = T.corpus(spark, sf_dir)
    mean = (corpus.select(F.posexplode("embedding").alias("i", "v")).groupBy("i")
            .agg(F.avg("v").alias("v")).orderBy("i").collect())  # one value per dimension
    hits = K.find_recommendations(corpus, [r["v"] for r in mean], "en", limit=3)
    w = Window.orderBy("distance", "id")  # three rows after the limit
    return hits.select(F.row_number().over(w).cast("int").alias("hit_rank"), F.col("id").alias("corpus_id"),
                       F.round("distance", 6).alias("distance"), "segment", "recommendation")


def prompt_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + V4: per request, hits in rank order and the prompt text."""
    reqs = T.requests_from_embeddings(spark, sf_dir)
    hits = K.knn_join(reqs, T.corpus(spark, sf_dir), ["language"], k=3)
    return K.prompt_digest(reqs.select("request_id", "language", "query_text"), hits)


def prompt_no_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: requests of which a third name a segment without texts: the no-hit prompt."""
    reqs = T.requests_from_embeddings(spark, sf_dir)
    reqs = reqs.withColumn("segment", F.when(F.col("request_id") % 3 == 0, "none").otherwise(F.col("segment")))
    hits = K.knn_join(reqs, T.corpus(spark, sf_dir), ["language", "segment"], k=3)
    return K.prompt_digest(reqs.select("request_id", "language", "query_text"), hits)


def prompt_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + V1 + V4: the dominant segment's prompt in both languages, from the texts
    of that segment nearest to the language's mean vector; and for a segment without texts."""
    top = _summary(spark, sf_dir).agg(F.max_by("seg_ord", F.struct(F.col("customers"), -F.col("seg_ord"))).alias("seg_ord"))
    corpus = T.corpus(spark, sf_dir)
    means = (corpus.select("language", F.posexplode("embedding").alias("i", "v")).groupBy("language", "i").agg(F.avg("v").alias("v"))
             .groupBy("language").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("query_vec")))
    names = spark.createDataFrame([(r[0], lang, r[i]) for r in SEGMENTS for lang, i in (("ru", 2), ("en", 3))],
                                  "seg_ord INT, language STRING, segment_name STRING")
    reqs = (top.join(names, "seg_ord").join(means, "language")
            .select("language", "segment_name", "query_vec", F.explode(F.array(F.col("seg_ord").cast("string"), F.lit("none"))).alias("segment"))
            .withColumn("request_id", F.concat_ws("/", "language", "segment")))
    hits = K.knn_join(reqs, corpus, ["language", "segment"], k=3)
    return K.dominant_prompt(reqs, hits)


def corpus_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-refresh write of the corpus with a vector-width check, read back."""
    from ..sources.sinks import load_corpus
    return load_corpus(T.corpus(spark, sf_dir)).withColumn("dim", F.size("embedding").cast("int")) \
        .drop("embedding")


# --- message history ------------------------------------------------------------

def _local(spark, sf_dir):
    m = H.with_user_zone(T.message_log(spark, sf_dir), T.users(spark, sf_dir))
    return m.withColumn("local_ts", H.local_time(F.col("timestamp"), F.col("timezone")))


def history_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + W5: every message in its user's local time."""
    return _local(spark, sf_dir).select("id", "user_id", "timezone", "timezone_set", "local_ts")


def _page0(spark, sf_dir):
    # Page first (partial per-partition limit before the shuffle), then look up
    # zones and convert times for at most page_size rows per user.
    page = H.history_page(T.message_log(spark, sf_dir), page=0)
    page = H.with_user_zone(page, T.users(spark, sf_dir))
    return page.withColumn("local_ts", H.local_time(F.col("timestamp"), F.col("timezone")))


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + A6 + W6: first page of every user with rendered lines."""
    p = H.render_lines(_page0(spark, sf_dir))
    return p.select("user_id", F.col("rn").cast("int").alias("rn"), "id", "local_ts", "line", "total", "pages",
                    "has_prev", "has_next")


def history_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 + X1: the first page of every user as text with title and day headers, in
    parts of at most 400 characters."""
    p = H.render_lines(_page0(spark, sf_dir), period="day", lang="en")
    return chunk_text(H.page_text(p), "text", "user_id", 400)


def history_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth page of every user that has one."""
    return H.history_page_deep(T.message_log(spark, sf_dir), page=3, bucket_seconds=86400).select("user_id", "id", "rn", "total")


def history_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day, week (%U) and month keys of every message in local time."""
    ts = F.col("local_ts")
    return _local(spark, sf_dir).select("id", "user_id", period_key(ts, "day").alias("day_key"),
                                        period_key(ts, "week", "en").alias("week_key"),
                                        period_key(ts, "month").alias("month_key"))


def history_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week header where the key changes inside the first page."""
    p = H.render_lines(_page0(spark, sf_dir), period="week", lang="en")
    return p.select("user_id", F.col("rn").cast("int").alias("rn"), "period_key", "header")


def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest-first position of every message inside its user."""
    return H.newest_first_positions(T.message_log(spark, sf_dir)).select("user_id", "id", "rn")


def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest message time per user."""
    from ..operators.upsert import last_seen as ls
    return ls(T.message_log(spark, sf_dir))


# --- throttling ---------------------------------------------------------------

def recent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 30 s count per message (itself included)."""
    return TH.trailing_count(T.message_log(spark, sf_dir), 30).select("id", "user_id", "recent")


def over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: rows over a limit of 5 per day (a setting that fires on the test data)."""
    return TH.over_limit(T.message_log(spark, sf_dir), 5, 86400).select("id", "user_id", "recent")


def mute_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M3: recursive mute decision, limit 5 per day, 1 day mute."""
    return TH.mute_fold(T.message_log(spark, sf_dir), 5, 86400, 86400)


def mute_fold_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with ``counts_towards_limit``: views are saved but not counted, limit 3 per day."""
    return TH.mute_fold(T.message_log(spark, sf_dir), 3, 86400, 86400, counts_towards_limit=~F.col("message").startswith("view"))


def mute_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: the mutes the fold produced."""
    return TH.mute_intervals(TH.mute_fold(T.message_log(spark, sf_dir), 5, 86400, 86400))


# --- text -----------------------------------------------------------------------

def text_bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 on every conversation turn."""
    c = T.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", boldify("text").alias("text"))


def text_bold_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 on texts full of ``**``: every full stop becomes one."""
    c = T.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", boldify(F.replace(F.col("text"), F.lit("."), F.lit("**"))).alias("text"))


def text_wrap50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 on every conversation turn."""
    c = T.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", wrap_fixed("text", 50).alias("text"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 on every document, whole texts, parts of at most 4096 characters."""
    return chunk_text(T.table(spark, sf_dir, "documents"), "text", "doc_id", 4096)


# --- CSV scan ---------------------------------------------------------------------

def _scan(spark, sf_dir):
    from ..session import scratch_path
    path = T.write_customer_csv(spark, sf_dir, scratch_path(spark, "customers-csv"))
    return CS.read_csv_robust(spark, path, glob=None)


def csv_scan_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows of the customer CSV written from the tables."""
    return _scan(spark, sf_dir).accepted


def csv_scan_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined lines with the reason."""
    return _scan(spark, sf_dir).rejected.select("raw", "reason")


def csv_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: NA tokens -> null."""
    return CS.null_tokens(_scan(spark, sf_dir).accepted)


def alias_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header aliases -> canonical columns (unknown columns dropped)."""
    return project_canonical(CS.null_tokens(_scan(spark, sf_dir).accepted))


def preview_first5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five accepted rows by client id."""
    acc = _scan(spark, sf_dir).accepted
    return CS.preview(acc.withColumn("_id", F.col("Client").cast("long")), ["_id"]).drop("_id")


def csv_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8 from the CSV file: scan, guard, resolve headers, clean, score, segment."""
    scan = _scan(spark, sf_dir)
    CS.check_usable(scan)
    raw = CS.null_tokens(scan.accepted)
    return analyze(project_canonical(raw), as_of=T.AS_OF).scored


# --- keyed writes -------------------------------------------------------------------

def _signup_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    return e.select(F.col("user_id").alias("id"),
                    F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("_"),
                             F.col("event_id").cast("string")).alias("username"),
                    F.concat(F.lit("Name"), F.col("user_id").cast("string")).alias("first_name"),
                    F.col("event_id").alias("_version"))


def _zone_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return e.select(F.col("user_id").alias("id"), T.zone_expr(F.col("event_id")).alias("timezone"),
                    F.lit(True).alias("timezone_set"), F.col("event_id").alias("_version"))


def _delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    return e.where((F.col("event_type") == "purchase") & (F.col("value") > 49)).select("user_id")


USER_DEFAULTS = {"timezone": "Europe/Moscow", "timezone_set": False}


def users_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: every signup event re-saves its user; the newest change wins;
    the chosen zone is kept (only username and first_name are overwritten)."""
    from ..operators.upsert import upsert
    return upsert(T.users(spark, sf_dir), _signup_changes(spark, sf_dir), "id", columns=["username", "first_name"],
                  defaults=USER_DEFAULTS)


def users_zone_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: zone changes (one per error event, newest wins) set zone and flag."""
    from ..operators.upsert import upsert
    return upsert(T.users(spark, sf_dir), _zone_changes(spark, sf_dir), "id", columns=["timezone", "timezone_set"],
                  defaults=USER_DEFAULTS)


def history_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: clear the history of every user with a purchase above 49."""
    from ..operators.upsert import delete_keys
    return delete_keys(T.message_log(spark, sf_dir), _delete_requests(spark, sf_dir), "user_id").select("id", "user_id")


def _keyed(spark: SparkSession, name: str, rows: DataFrame, key: str, order: tuple[str, ...] = ()):
    """A fresh keyed table that holds ``rows``."""
    from ..session import scratch_path
    from ..sources.keyed_table import KeyedTable
    table = KeyedTable.create(spark, scratch_path(spark, name), rows.schema, key, order, buckets=16)
    table.replace_all(rows)
    return table


def users_upsert_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 as a committed write to the users table, sent twice: the second time adds nothing."""
    table = _keyed(spark, "users", T.users(spark, sf_dir), "id")
    for _ in range(2):
        table.upsert(_signup_changes(spark, sf_dir), columns=["username", "first_name"], defaults=USER_DEFAULTS, writer="signup", epoch=0)
    return table.read()


def users_zone_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 as a committed write to the users table."""
    table = _keyed(spark, "users", T.users(spark, sf_dir), "id")
    table.upsert(_zone_changes(spark, sf_dir), columns=["timezone", "timezone_set"], defaults=USER_DEFAULTS)
    return table.read()


def history_delete_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 as a committed write: only the buckets of the deleted users are rewritten."""
    table = _keyed(spark, "history", T.message_log(spark, sf_dir), "user_id", ("timestamp", "id"))
    table.delete(_delete_requests(spark, sf_dir))
    return table.read().select("id", "user_id")


def history_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + T1: the messages of the user with the smallest id, newest first, from
    that user's bucket of the history table."""
    msgs = T.message_log(spark, sf_dir)
    table = _keyed(spark, "history", msgs, "user_id", ("timestamp", "id"))
    user = msgs.agg(F.min("user_id")).first()[0]
    newest = Window.orderBy(F.col("timestamp").desc(), F.col("id").desc())  # one user's rows
    return table.read_key(user).select("id", "message", "timestamp", F.row_number().over(newest).cast("int").alias("rn"))


def mutes_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 / M3: mutes not yet expired at 2024-01-30 00:00."""
    m = TH.mute_intervals(TH.mute_fold(T.message_log(spark, sf_dir), 5, 86400, 86400))
    return TH.active_mutes(m, "2024-01-30 00:00:00")


def segment_localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 + C15: each customer's segment in their language; unsupported
    languages fall back to Russian."""
    scored = rfm_segments(spark, sf_dir)
    c = T.table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_nationkey") % 3 == 0, "ru").when(F.col("c_nationkey") % 3 == 1, "en").otherwise("de")
    u = c.select(normalize_id(F.col("c_custkey").cast("string")).alias("Buyer"), raw.alias("lang_raw"))
    lang = S.language_or_default(F.col("lang_raw"))
    local = F.when(lang == "en", S.translate_segment(F.col("Segment"), "en")).otherwise(
        S.translate_segment(F.col("Segment"), "ru"))
    return scored.join(u, "Buyer").select("Buyer", "lang_raw", lang.alias("lang"), local.alias("segment_local"))


# --- streaming ------------------------------------------------------------------

def _stream_dirs(spark, name):
    from ..session import scratch_path
    return scratch_path(spark, f"{name}-sink"), scratch_path(spark, f"{name}-ckpt")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: events streamed into the message table (runs to completion)."""
    from ..streaming import ingest as I
    sink, ck = _stream_dirs(spark, "messages")
    I.ingest(I.as_messages(I.event_stream(spark, sf_dir)), sink, ck).awaitTermination()
    return spark.read.parquet(sink)


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + ST1: events appended to the keyed history by micro-batch; the last
    batch comes a second time and adds nothing, and the table is compacted."""
    from ..session import scratch_path
    from ..sources.keyed_table import KeyedTable
    from ..streaming import ingest as I
    msgs = I.as_messages(I.event_stream(spark, sf_dir))
    table = KeyedTable.create(spark, scratch_path(spark, "history"), msgs.schema, "user_id", ("timestamp", "id"), buckets=16)
    I.append_stream(msgs, table, _stream_dirs(spark, "append")[1], "ingest").awaitTermination()
    table.append(T.message_log(spark, sf_dir), "ingest", table.manifest().epochs["ingest"])
    table.compact()
    return table.read()


def _throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decisions and mute ends of the throttle stream over ``events``."""
    from ..session import scratch_path
    from ..streaming import ingest as I
    from ..streaming.throttle import state_store, throttle_events
    sink, ck = _stream_dirs(spark, "throttle")
    marks = scratch_path(spark, "end")
    msgs = I.as_messages(I.event_stream(spark, sf_dir))
    out = throttle_events(I.until_end(msgs, marks), 5, 86400, 86400, watermark="1 day")
    with state_store(spark):
        I.run_to_end(out, sink, ck, msgs.schema, marks, at_once=True)  # event_stream has no rate limit here
    return spark.read.parquet(sink)


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: the mute decision as a stateful stream in event-time order; equals ``mute_fold``."""
    return _throttled(spark, sf_dir).where("status <> 'unmuted'")


def mutes_expired_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 as a stream: every mute, emitted by the timer of its end; equals
    ``mute_intervals`` once the stream has passed all of them."""
    from ..streaming.throttle import expired_mutes
    return expired_mutes(_throttled(spark, sf_dir), 86400)


def stream_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: last-seen per user maintained by a stream; equals ``last_seen``."""
    from ..streaming import ingest as I
    from ..streaming.last_seen import last_seen_stream, read_table
    table, ck = _stream_dirs(spark, "last-seen")
    last_seen_stream(I.as_messages(I.event_stream(spark, sf_dir)), table, ck).awaitTermination()
    return read_table(spark, table)


# --- named steps of SURVEY §2 ------------------------------------------------------

def _kept(spark, sf_dir):
    typed = typed_frame(_dirty(spark, sf_dir), T.AS_OF, passthrough=("row_key",))
    return typed.where(F.col("client_id").isNotNull() & F.col("date").isNotNull())


def drop_bad_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id or a parseable date are dropped."""
    return _kept(spark, sf_dir).select("row_key", "client_id", "date")


def recency_from_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: days from the last purchase to as_of (negative when after it)."""
    return _kept(spark, sf_dir).select("row_key", "recency")


def clamp_negative_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative amounts and recencies -> 0 (gaps stay gaps)."""
    return clamp_negative(_kept(spark, sf_dir).select("row_key", "amount", "recency"), ["amount", "recency"])


def rfm_no_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No frequency column -> Frequency 1, F by first-come rank."""
    return analyze(T.customer_metrics(spark, sf_dir, T.AS_OF).drop("frequency"), as_of=T.AS_OF).scored


def r_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: R score per customer."""
    return rfm_segments(spark, sf_dir).select("Buyer", "Recency", "R_Score")


def f_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: F score per customer."""
    return rfm_segments(spark, sf_dir).select("Buyer", "Frequency", "F_Score")


def m_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: M score per customer."""
    return rfm_segments(spark, sf_dir).select("Buyer", "Monetary", "M_Score")


def segment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: segment rules, English names."""
    res = analyze(T.customer_metrics(spark, sf_dir, T.AS_OF), as_of=T.AS_OF, lang="en")
    return res.scored.select("Buyer", "R_Score", "F_Score", "M_Score", "Segment")


def knn_join_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: top 5 per request within its language and segment."""
    reqs = T.requests_from_embeddings(spark, sf_dir)
    hits = K.knn_join(reqs, T.corpus(spark, sf_dir), ["language", "segment"], k=5)
    return hits.withColumn("distance", F.round("distance", 6))


def history_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered history lines of the first page."""
    return history_page(spark, sf_dir).select("user_id", "rn", "line")


def corpus_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector count and width range per language (one aggregation)."""
    c = T.corpus(spark, sf_dir)
    return c.groupBy("language").agg(F.count(F.lit(1)).alias("vectors"),
                                     F.min(F.size("embedding")).cast("int").alias("min_dim"),
                                     F.max(F.size("embedding")).cast("int").alias("max_dim"))


def csv_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 for the CSV flow: quarantined lines plus the cleaning counters."""
    scan = _scan(spark, sf_dir)
    res = clean_customers(project_canonical(CS.null_tokens(scan.accepted)), as_of=T.AS_OF)
    lines = scan.rejected.count()
    rows = [("rejected", "lines", int(lines))] + [
        (k.split(":")[0], k.split(":")[1], int(v)) for k, v in res.counts.items()]
    return spark.createDataFrame(rows, "rule STRING, column STRING, n BIGINT")


QUERIES: dict[str, Query] = {
    "prompt_no_hits": prompt_no_hits,
    "prompt_dominant": prompt_dominant,
    "history_page_text": history_page_text,
    "history_page_deep": history_page_deep,
    "text_bold_marked": text_bold_marked,
    "score_few_values": score_few_values,
    "parse_date_layouts": parse_date_layouts,
    "label_fallback": label_fallback,
    "rfm_segments": rfm_segments,
    "segment_summary": segment_summary,
    "score_fallback": score_fallback,
    "score_tied": score_tied,
    "f_score_repeated_ids": f_score_repeated_ids,
    "normalize_id": normalize_id_q,
    "text_to_number": text_to_number_q,
    "parse_dates": parse_dates_q,
    "impute_median": impute_median_q,
    "clean_customers": clean_customers_q,
    "quality_report": quality_report_q,
    "rfm_dirty": rfm_dirty,
    "segment_report": segment_report,
    "extract_counts": extract_counts,
    "dominant_segment": dominant_segment,
    "quantile_edges": quantile_edges,
    "rank_first": rank_first,
    "knn_filtered": knn_filtered,
    "knn_unfiltered": knn_unfiltered,
    "knn_blocked": knn_blocked,
    "knn_centroid": knn_centroid,
    "prompt_digest": prompt_digest,
    "corpus_load": corpus_load,
    "history_local": history_local,
    "history_page": history_page,
    "history_period": history_period,
    "history_headers": history_headers,
    "history_latest": history_latest,
    "last_seen": last_seen,
    "recent_count": recent_count,
    "over_limit": over_limit,
    "mute_fold": mute_fold,
    "mute_fold_counted": mute_fold_counted,
    "mute_intervals": mute_intervals,
    "text_bold": text_bold,
    "text_wrap50": text_wrap50,
    "doc_chunks": doc_chunks,
    "csv_scan_accept": csv_scan_accept,
    "csv_scan_reject": csv_scan_reject,
    "csv_null_tokens": csv_null_tokens,
    "alias_project": alias_project,
    "preview_first5": preview_first5,
    "csv_rfm": csv_rfm,
    "users_upsert": users_upsert,
    "users_zone_update": users_zone_update,
    "history_delete": history_delete,
    "users_upsert_written": users_upsert_written,
    "users_zone_written": users_zone_written,
    "history_delete_written": history_delete_written,
    "history_keyed": history_keyed,
    "stream_append": stream_append,
    "mutes_active": mutes_active,
    "segment_localized": segment_localized,
    "stream_ingest": stream_ingest,
    "stream_throttle": stream_throttle,
    "mutes_expired_stream": mutes_expired_stream,
    "stream_last_seen": stream_last_seen,
    "drop_bad_dates": drop_bad_dates,
    "recency_from_date": recency_from_date,
    "clamp_negative": clamp_negative_q,
    "rfm_no_frequency": rfm_no_frequency,
    "r_score": r_score,
    "f_score": f_score,
    "m_score": m_score,
    "segment_assign": segment_assign,
    "knn_join": knn_join_q,
    "history_render": history_render,
    "corpus_dim_check": corpus_dim_check,
    "csv_quality_report": csv_quality_report,
}

ORACLE_SQL: dict[str, str] = {
    "prompt_no_hits": Q.PROMPT_NO_HITS,
    "prompt_dominant": Q.PROMPT_DOMINANT,
    "history_page_text": Q.HISTORY_PAGE_TEXT,
    "history_page_deep": Q.HISTORY_PAGE_DEEP,
    "text_bold_marked": Q.TEXT_BOLD_MARKED,
    "score_few_values": Q.SCORE_FEW_VALUES,
    "parse_date_layouts": Q.PARSE_DATE_LAYOUTS,
    "label_fallback": Q.LABEL_FALLBACK,
    "rfm_segments": Q.RFM_SEGMENTS,
    "segment_summary": Q.SEGMENT_SUMMARY,
    "score_fallback": Q.SCORE_FALLBACK,
    "score_tied": Q.SCORE_TIED,
    "f_score_repeated_ids": Q.F_SCORE_REPEATED_IDS,
    "normalize_id": Q.NORMALIZE_ID,
    "text_to_number": Q.TEXT_TO_NUMBER,
    "parse_dates": Q.PARSE_DATES,
    "impute_median": Q.IMPUTE_MEDIAN,
    "clean_customers": Q.CLEAN_CUSTOMERS,
    "quality_report": Q.QUALITY_REPORT,
    "rfm_dirty": Q.RFM_DIRTY,
    "segment_report": Q.SEGMENT_REPORT,
    "extract_counts": Q.EXTRACT_COUNTS,
    "dominant_segment": Q.DOMINANT_SEGMENT,
    "quantile_edges": Q.QUANTILE_EDGES,
    "rank_first": Q.RANK_FIRST,
    "knn_filtered": Q.KNN_FILTERED,
    "knn_unfiltered": Q.KNN_UNFILTERED,
    "knn_blocked": Q.KNN_UNFILTERED,
    "knn_centroid": Q.KNN_CENTROID,
    "prompt_digest": Q.PROMPT_DIGEST,
    "corpus_load": Q.CORPUS_LOAD,
    "history_local": Q.HISTORY_LOCAL,
    "history_page": Q.HISTORY_PAGE,
    "history_period": Q.HISTORY_PERIOD,
    "history_headers": Q.HISTORY_HEADERS,
    "history_latest": Q.HISTORY_LATEST,
    "last_seen": Q.LAST_SEEN,
    "recent_count": Q.RECENT_COUNT,
    "over_limit": Q.OVER_LIMIT,
    "mute_fold": Q.MUTE_FOLD,
    "mute_fold_counted": Q.MUTE_FOLD_COUNTED,
    "mute_intervals": Q.MUTE_INTERVALS,
    "text_bold": Q.TEXT_BOLD,
    "text_wrap50": Q.TEXT_WRAP50,
    "doc_chunks": Q.DOC_CHUNKS,
    "csv_scan_accept": Q.CSV_SCAN_ACCEPT,
    "csv_scan_reject": Q.CSV_SCAN_REJECT,
    "csv_null_tokens": Q.CSV_NULL_TOKENS,
    "alias_project": Q.ALIAS_PROJECT,
    "preview_first5": Q.PREVIEW_FIRST5,
    "csv_rfm": Q.CSV_RFM,
    "users_upsert": Q.USERS_UPSERT,
    "users_zone_update": Q.USERS_ZONE_UPDATE,
    "history_delete": Q.HISTORY_DELETE,
    "users_upsert_written": Q.USERS_UPSERT,
    "users_zone_written": Q.USERS_ZONE_UPDATE,
    "history_delete_written": Q.HISTORY_DELETE,
    "history_keyed": Q.HISTORY_KEYED,
    "stream_append": Q.STREAM_INGEST,
    "mutes_active": Q.MUTES_ACTIVE,
    "segment_localized": Q.SEGMENT_LOCALIZED,
    "stream_ingest": Q.STREAM_INGEST,
    "stream_throttle": Q.MUTE_FOLD,
    "mutes_expired_stream": Q.MUTE_INTERVALS,
    "stream_last_seen": Q.LAST_SEEN,
    "drop_bad_dates": Q.DROP_BAD_DATES,
    "recency_from_date": Q.RECENCY_FROM_DATE,
    "clamp_negative": Q.CLAMP_NEGATIVE,
    "rfm_no_frequency": Q.RFM_NO_FREQUENCY,
    "r_score": Q.R_SCORE,
    "f_score": Q.F_SCORE,
    "m_score": Q.M_SCORE,
    "segment_assign": Q.SEGMENT_ASSIGN,
    "knn_join": Q.KNN_JOIN,
    "history_render": Q.HISTORY_RENDER,
    "corpus_dim_check": Q.CORPUS_DIM_CHECK,
    "csv_quality_report": Q.CSV_QUALITY_REPORT,
}
