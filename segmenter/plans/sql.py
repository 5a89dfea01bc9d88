"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each text is independent SQL over the supplied tables; shared fragments are
built here from the same fixed values the Spark code uses.
"""

from __future__ import annotations

from ..schemas import SEGMENTS
from ..sources.tables import ADAPTER_ZONES, AS_OF, AS_OF_TIED


def segment_case(r: str = "R_Score", f: str = "F_Score", m: str = "M_Score", lang: str = "ru") -> str:
    """Segment of three scores: by R, the sums of F and M from which a better segment begins."""
    name = {row[1]: row[2 if lang == "ru" else 3] for row in SEGMENTS}
    fm = f"({f} + {m})"
    # R: [(least F + M, segment), ...], best first.
    bands = {5: [(10, "VIP"), (7, "Loyal"), (2, "New")], 4: [(8, "Loyal"), (6, "New"), (5, "At-Risk"), (2, "New")],
             3: [(9, "Loyal"), (2, "At-Risk")], 2: [(10, "Loyal"), (5, "At-Risk"), (2, "Lost")], 1: [(5, "At-Risk"), (2, "Lost")]}
    arms = [f"WHEN {r} = {k} AND {fm} >= {least} THEN '{name[code]}'" for k, steps in bands.items() for least, code in steps]
    return f"CASE {' '.join(arms)} END"


def norm_id(x: str) -> str:
    b = f"regexp_replace({x}, '[\\s\\-()]', '', 'g')"
    return f"(CASE WHEN starts_with({b}, '8') THEN '+7' || substr({b}, 2) ELSE {b} END)"


def metrics_cte(as_of: str = AS_OF, frequency: bool = True) -> str:
    freq = "CAST(count(*) AS DOUBLE)" if frequency else "CAST(1.0 AS DOUBLE)"
    return f"""m AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cid,
         CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{as_of}') AS DOUBLE) AS recency,
         round(sum(o_totalprice), 2) AS amount,
         {freq} AS frequency
  FROM orders GROUP BY o_custkey)"""


def tied_cte() -> str:
    return """m AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS cid,
         CAST(max(l_linenumber) AS DOUBLE) AS recency,
         round(sum(l_extendedprice), 2) AS amount,
         CAST(count(*) AS DOUBLE) AS frequency
  FROM lineitem GROUP BY l_orderkey)"""


def scored_sql(source_cte: str, lang: str = "ru") -> str:
    """Scores with the reference's route for data whose three measures each have
    at least five distinct values: a measure whose five-bin edges repeat scores 1."""
    def inner(col: str, e: str) -> str:
        return " + ".join(f"CAST({col} > {e}[{i}] AS INTEGER)" for i in (2, 3, 4, 5))

    return f"""WITH {source_cte},
c AS (
  SELECT {norm_id('cid')} AS Buyer, greatest(recency, 0.0) AS Recency,
         greatest(amount, 0.0) AS Monetary, greatest(frequency, 0.0) AS Frequency
  FROM m),
q AS (
  SELECT quantile_cont(Recency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS re,
         quantile_cont(Monetary, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS me,
         count(*) AS n FROM c),
ok AS (
  SELECT q.*,
         (re[1] < re[2] AND re[2] < re[3] AND re[3] < re[4] AND re[4] < re[5] AND re[5] < re[6]) AS ok_r,
         (me[1] < me[2] AND me[2] < me[3] AND me[3] < me[4] AND me[4] < me[5] AND me[5] < me[6]) AS ok_m
  FROM q),
r AS (SELECT c.*, row_number() OVER (ORDER BY Frequency, Buyer) AS rn FROM c),
s AS (
  SELECT Buyer, Recency, Monetary, Frequency,
         CAST(CASE WHEN ok_r THEN 6 - (1 + {inner('Recency', 're')}) ELSE 1 END AS INTEGER) AS R_Score,
         CAST(CASE WHEN n < 2 THEN 1 ELSE greatest(1, ceil(5.0 * (rn - 1) / (n - 1))) END AS INTEGER) AS F_Score,
         CAST(CASE WHEN ok_m THEN 1 + {inner('Monetary', 'me')} ELSE 1 END AS INTEGER) AS M_Score
  FROM r CROSS JOIN ok)
SELECT *, {segment_case(lang=lang)} AS Segment FROM s"""


def summary_sql(scored: str, lang: str = "ru") -> str:
    idx = 2 if lang == "ru" else 3
    values = ", ".join(f"('{row[idx]}', {row[0]})" for row in SEGMENTS)
    return f"""WITH sc AS ({scored}),
d(segment, seg_ord) AS (VALUES {values}),
a AS (SELECT Segment AS segment, count(*) AS cnt, avg(Monetary) AS av, sum(Monetary) AS tot
      FROM sc GROUP BY Segment)
SELECT d.segment, CAST(d.seg_ord AS INTEGER) AS seg_ord, CAST(coalesce(a.cnt, 0) AS BIGINT) AS customers,
       round(coalesce(a.av, 0.0), 2) AS avg_check, round(coalesce(a.tot, 0.0), 2) AS total_check
FROM d LEFT JOIN a ON a.segment = d.segment"""


RFM_SEGMENTS = scored_sql(metrics_cte(AS_OF))
SCORE_FALLBACK = scored_sql(metrics_cte(AS_OF_TIED))
SCORE_TIED = scored_sql(tied_cte())

F_SCORE_REPEATED_IDS = """WITH r AS (
  SELECT '1' || CAST(o_custkey AS VARCHAR) AS Buyer, count(*) OVER () AS n,
         row_number() OVER (ORDER BY '1' || CAST(o_custkey AS VARCHAR)) AS rn FROM orders),
s AS (SELECT Buyer, CAST(CASE WHEN n < 2 THEN 1 ELSE greatest(1, ceil(5.0 * (rn - 1) / (n - 1))) END AS INTEGER) AS F_Score FROM r)
SELECT Buyer, F_Score, count(*) AS n FROM s GROUP BY Buyer, F_Score"""
SEGMENT_SUMMARY = summary_sql(RFM_SEGMENTS)
ZONES_CASE = "CASE " + " ".join(f"WHEN c_nationkey % {len(ADAPTER_ZONES)} = {i} THEN '{z}'"
                                for i, z in enumerate(ADAPTER_ZONES)) + " END"


# --- dirty input and cleaning -------------------------------------------------

DIRTY_CTE = """dirty AS (
  SELECT c.c_custkey AS row_key,
    CASE WHEN c_custkey % 23 = 0 THEN NULL
         WHEN c_custkey % 2 = 0 THEN '8 (900) ' || CAST(c_custkey AS VARCHAR) || '-45-67'
         ELSE 'C-' || CAST(c_custkey AS VARCHAR) END AS client_id,
    CASE WHEN c_custkey % 17 = 0 THEN NULL
         WHEN c_custkey % 19 = 0 THEN 'two hundred five'
         WHEN c_custkey % 13 = 0 THEN 'n/a'
         WHEN c_custkey % 11 = 0 THEN 'twenty-one'
         ELSE CAST(c_acctbal AS VARCHAR) END AS amount,
    CASE WHEN c_custkey % 7 = 0 THEN 'NA'
         WHEN c_custkey % 5 = 0 THEN ' ' || CAST(cnt AS VARCHAR) || ' '
         ELSE CAST(cnt AS VARCHAR) END AS frequency,
    CASE WHEN c_custkey % 29 = 0 THEN 'unknown'
         WHEN c_custkey % 3 = 0 THEN strftime(last, '%Y-%m-%d')
         WHEN c_custkey % 3 = 1 THEN strftime(last, '%d.%m.%Y')
         ELSE strftime(last, '%m/%d/%Y') END AS date
  FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS cnt
                             FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)"""


def num(x: str) -> str:
    t = f"lower(trim({x}))"
    return (f"(CASE WHEN {t} = 'two hundred five' THEN 205.0 WHEN {t} = 'twenty-one' THEN 21.0 "
            f"WHEN regexp_full_match({t}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN TRY_CAST({t} AS DOUBLE) END)")


def date(x: str) -> str:
    return (f"CAST(coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%d.%m.%Y'), "
            f"try_strptime({x}, '%m/%d/%Y')) AS TIMESTAMP)")


TYPED_CTE = f"""{DIRTY_CTE},
typed AS (
  SELECT row_key, {norm_id('client_id')} AS client_id, {date('date')} AS date,
         {num('amount')} AS amount, {num('frequency')} AS frequency
  FROM dirty),
kept AS (
  SELECT row_key, client_id, date,
         CAST(date_diff('day', CAST(date AS DATE), DATE '{AS_OF}') AS DOUBLE) AS recency, amount, frequency
  FROM typed WHERE client_id IS NOT NULL AND date IS NOT NULL),
med AS (SELECT median(amount) AS ma, median(frequency) AS mf FROM kept)"""

NORMALIZE_ID = f"""WITH {DIRTY_CTE}
SELECT row_key, client_id AS raw_id, {norm_id('client_id')} AS client_id FROM dirty"""

TEXT_TO_NUMBER = f"""WITH {DIRTY_CTE}
SELECT row_key, amount AS raw_amount, {num('amount')} AS amount,
       frequency AS raw_frequency, {num('frequency')} AS frequency FROM dirty"""

PARSE_DATES = f"""WITH {DIRTY_CTE}
SELECT row_key, date AS raw_date, {date('date')} AS date,
       CAST(date_diff('day', CAST({date('date')} AS DATE), DATE '{AS_OF}') AS DOUBLE) AS recency FROM dirty"""

IMPUTE_MEDIAN = f"""WITH {TYPED_CTE}
SELECT row_key, coalesce(amount, ma) AS amount, coalesce(frequency, mf) AS frequency FROM kept, med"""

CLEAN_CUSTOMERS = f"""WITH {TYPED_CTE}
SELECT row_key, client_id, date, greatest(recency, 0.0) AS recency,
       greatest(coalesce(amount, ma), 0.0) AS amount, greatest(coalesce(frequency, mf), 0.0) AS frequency
FROM kept, med"""

QUALITY_REPORT = f"""WITH {TYPED_CTE},
t AS (SELECT
  count_if(client_id IS NULL) AS null_id,
  count_if(client_id IS NOT NULL AND date IS NULL) AS bad_date FROM typed),
k AS (SELECT
  count_if(recency < 0) AS neg_r,
  count_if(amount IS NULL) AS null_a, count_if(coalesce(amount, (SELECT ma FROM med)) < 0) AS neg_a,
  count_if(frequency IS NULL) AS null_f, count_if(coalesce(frequency, (SELECT mf FROM med)) < 0) AS neg_f
  FROM kept)
SELECT * FROM (VALUES ('rejected', 'null_id'), ('rejected', 'bad_date'),
  ('filled', 'recency'), ('clamped', 'recency'), ('dropped', 'recency'),
  ('filled', 'amount'), ('clamped', 'amount'), ('dropped', 'amount'),
  ('filled', 'frequency'), ('clamped', 'frequency'), ('dropped', 'frequency')) AS r(rule, "column")
CROSS JOIN LATERAL (SELECT CAST(CASE
  WHEN r.rule = 'rejected' AND r."column" = 'null_id' THEN (SELECT null_id FROM t)
  WHEN r.rule = 'rejected' THEN (SELECT bad_date FROM t)
  WHEN r.rule = 'clamped' AND r."column" = 'recency' THEN (SELECT neg_r FROM k)
  WHEN r.rule = 'filled' AND r."column" = 'amount' THEN (SELECT null_a FROM k)
  WHEN r.rule = 'clamped' AND r."column" = 'amount' THEN (SELECT neg_a FROM k)
  WHEN r.rule = 'filled' AND r."column" = 'frequency' THEN (SELECT null_f FROM k)
  WHEN r.rule = 'clamped' AND r."column" = 'frequency' THEN (SELECT neg_f FROM k)
  ELSE 0 END AS BIGINT) AS n) x"""

RFM_DIRTY = scored_sql(f"""{TYPED_CTE},
m AS (SELECT client_id AS cid, recency, coalesce(amount, ma) AS amount, coalesce(frequency, mf) AS frequency
      FROM kept, med)""")


# --- report, dominant segment, statistics -----------------------------------

def report_sql(summary: str, lang: str = "ru") -> str:
    from ..operators.summary import REPORT_TEXT
    t = REPORT_TEXT[lang]
    return f"""WITH su AS ({summary})
SELECT chr(10) || '{t['title']}' || chr(10) || chr(10) || string_agg(
  segment || ':' || chr(10) || '  {t['customers']}: ' || CAST(customers AS VARCHAR) || chr(10) ||
  '  {t['avg']}: ' || printf('%.2f', avg_check) || ' {t['currency']}' || chr(10) ||
  '  {t['total']}: ' || printf('%.2f', total_check) || ' {t['currency']}' || chr(10) || chr(10), ''
  ORDER BY seg_ord) AS report FROM su"""


SEGMENT_REPORT = report_sql(SEGMENT_SUMMARY)
EXTRACT_COUNTS = f"""WITH su AS ({SEGMENT_SUMMARY}) SELECT segment, customers FROM su"""
DOMINANT_SEGMENT = f"""WITH su AS ({SEGMENT_SUMMARY})
SELECT arg_max(segment, customers * 10 - seg_ord) AS segment, max(customers) AS customers FROM su"""

QUANTILE_EDGES = f"""WITH {metrics_cte(AS_OF)},
c AS (SELECT greatest(recency, 0.0) AS Recency, greatest(amount, 0.0) AS Monetary,
             greatest(frequency, 0.0) AS Frequency FROM m),
q AS (SELECT quantile_cont(Recency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS r,
             quantile_cont(Monetary, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS mo,
             quantile_cont(Frequency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS f FROM c)
SELECT 'Recency' AS measure, CAST(i - 1 AS INTEGER) AS edge_no, round(r[i], 6) AS edge FROM q, range(1, 7) t(i)
UNION ALL SELECT 'Monetary', CAST(i - 1 AS INTEGER), round(mo[i], 6) FROM q, range(1, 7) t(i)
UNION ALL SELECT 'Frequency', CAST(i - 1 AS INTEGER), round(f[i], 6) FROM q, range(1, 7) t(i)"""

RANK_FIRST = f"""WITH {metrics_cte(AS_OF)},
c AS (SELECT {norm_id('cid')} AS Buyer, greatest(frequency, 0.0) AS Frequency FROM m)
SELECT Buyer, Frequency, row_number() OVER (ORDER BY Frequency, Buyer) AS rank FROM c"""


# --- similarity ---------------------------------------------------------------

CORPUS_CTE = """c AS (
  SELECT vec_id AS id, CAST(label AS VARCHAR) AS segment,
         CASE WHEN vec_id % 2 = 0 THEN 'ru' ELSE 'en' END AS language,
         'recommendation ' || CAST(vec_id AS VARCHAR) AS recommendation,
         CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings)"""


def knn_sql(keys: list[str], k: int = 3) -> str:
    on = " AND ".join(f"r.{x} = c.{x}" for x in keys)
    return f"""WITH {CORPUS_CTE},
p AS (
  SELECT r.id AS request_id, c.id AS corpus_id, list_distance(r.embedding, c.embedding) AS d,
         c.segment, c.recommendation,
         row_number() OVER (PARTITION BY r.id ORDER BY list_distance(r.embedding, c.embedding), c.id) AS hit_rank
  FROM c AS r JOIN c ON {on})
SELECT request_id, CAST(hit_rank AS INTEGER) AS hit_rank, corpus_id, round(d, 6) AS distance,
       segment, recommendation
FROM p WHERE hit_rank <= {k}"""


KNN_FILTERED = knn_sql(["language", "segment"])
KNN_UNFILTERED = knn_sql(["language"])

KNN_CENTROID = f"""WITH {CORPUS_CTE},
u AS (SELECT i, avg(v) AS v FROM (SELECT unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM c) GROUP BY i),
q AS (SELECT list(v ORDER BY i) AS qv FROM u),
p AS (SELECT c.id, c.segment, c.recommendation, list_distance(c.embedding, q.qv) AS d FROM c, q WHERE c.language = 'en')
SELECT CAST(row_number() OVER (ORDER BY d, id) AS INTEGER) AS hit_rank, id AS corpus_id, round(d, 6) AS distance,
       segment, recommendation
FROM p ORDER BY d, id LIMIT 3"""

PROMPT_DIGEST = f"""WITH h AS ({KNN_UNFILTERED}),
dg AS (SELECT request_id, string_agg(segment || ': ' || recommendation, chr(10) ORDER BY hit_rank) AS digest,
              count(*) AS n_hits FROM h GROUP BY request_id),
r AS (SELECT vec_id AS request_id, CASE WHEN vec_id % 2 = 0 THEN 'ru' ELSE 'en' END AS language,
             'request ' || CAST(vec_id AS VARCHAR) AS query_text FROM embeddings)
SELECT r.request_id, CAST(coalesce(n_hits, 0) AS BIGINT) AS n_hits, digest,
  CASE WHEN language = 'en' THEN 'User requested business recommendations'
       ELSE 'Пользователь запросил рекомендации по бизнесу' END || ': ''' || query_text || '''.' || chr(10) ||
  CASE WHEN n_hits > 0 THEN
    CASE WHEN language = 'en' THEN 'Here are preliminary recommendations from the database'
         ELSE 'Вот предварительные рекомендации из базы' END || ':' || chr(10) || digest || chr(10) ||
    CASE WHEN language = 'en' THEN 'Refine and enhance these recommendations to be as helpful and specific as possible for the business.'
         ELSE 'Уточни и дополни эти рекомендации, чтобы они были максимально полезны и конкретны для бизнеса.' END
  ELSE
    CASE WHEN language = 'en' THEN 'Provide specific and practical recommendations for improving the business.'
         ELSE 'Предложи конкретные и практические рекомендации для улучшения бизнеса.' END
  END AS prompt
FROM r LEFT JOIN dg USING (request_id)"""

PROMPT_NO_HITS = PROMPT_DIGEST.replace(KNN_UNFILTERED, KNN_FILTERED.replace(
    "FROM c AS r JOIN c ON", "FROM c AS r JOIN c ON r.id % 3 <> 0 AND"))

PROMPT_DOMINANT = f"""WITH {CORPUS_CTE},
top AS (SELECT seg_ord FROM ({SEGMENT_SUMMARY}) ORDER BY customers DESC, seg_ord LIMIT 1),
names(seg_ord, language, segment_name) AS (VALUES {', '.join(f"({r[0]}, '{lang}', '{r[i]}')" for r in SEGMENTS for lang, i in (('ru', 2), ('en', 3)))}),
u AS (SELECT language, i, avg(v) AS v FROM (SELECT language, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM c) GROUP BY language, i),
q AS (SELECT language, list(v ORDER BY i) AS qv FROM u GROUP BY language),
r AS (SELECT language, segment_name, qv, unnest([CAST(seg_ord AS VARCHAR), 'none']) AS segment FROM top JOIN names USING (seg_ord) JOIN q USING (language)),
h AS (SELECT r.language, r.segment, c.recommendation, row_number() OVER (PARTITION BY r.language, r.segment ORDER BY list_distance(c.embedding, r.qv), c.id) AS k
      FROM r JOIN c ON c.language = r.language AND c.segment = r.segment),
g AS (SELECT language, segment, string_agg(recommendation, chr(10) ORDER BY k) AS found FROM h WHERE k <= 3 GROUP BY language, segment)
SELECT language || '/' || segment AS request_id, language, segment_name,
  CASE WHEN language = 'en' THEN 'RFM analysis' ELSE 'RFM-анализ' END || ':' || chr(10) ||
  CASE WHEN language = 'en' THEN 'Dominant segment' ELSE 'Доминирующий сегмент' END || ': ' || segment_name || chr(10) ||
  CASE WHEN found IS NULL THEN
    CASE WHEN language = 'en' THEN 'Provide actionable recommendations for a mass-market retail business.'
         ELSE 'Предложи рекомендации для бизнеса масс-маркета (пиши не очень много)' END
  ELSE
    CASE WHEN language = 'en' THEN 'Preliminary recommendations' ELSE 'Предварительные рекомендации' END || ':' || chr(10) || found || chr(10) ||
    CASE WHEN language = 'en' THEN 'Refine and provide actionable recommendations for a mass-market retail business.'
         ELSE 'Уточни и дополни рекомендации для бизнеса масс-маркета. Пиши не очень много' END
  END AS prompt
FROM r LEFT JOIN g USING (language, segment)"""

CORPUS_LOAD = f"""WITH {CORPUS_CTE}
SELECT id, segment, language, recommendation, CAST(len(embedding) AS INTEGER) AS dim FROM c"""


# --- message history ------------------------------------------------------------

MSG_CTE = f"""msg AS (
  SELECT event_id AS id, user_id, concat_ws(' ', event_type, props) AS message, ts AS timestamp FROM events),
usr AS (SELECT c_custkey AS uid, {ZONES_CASE} AS tz, (c_nationkey % 4 <> 0) AS tz_set FROM customer),
loc AS (
  SELECT msg.*, coalesce(tz, '{'Europe/Moscow'}') AS timezone, coalesce(tz_set, false) AS timezone_set,
         CAST(timezone(coalesce(tz, 'Europe/Moscow'), timezone('UTC', msg.timestamp)) AS TIMESTAMP) AS local_ts
  FROM msg LEFT JOIN usr ON msg.user_id = usr.uid)"""

HISTORY_LOCAL = f"""WITH {MSG_CTE}
SELECT id, user_id, timezone, timezone_set, local_ts FROM loc"""


def wrap_sql(x: str, width: int = 50) -> str:
    return (f"(CASE WHEN length({x}) > {width} THEN array_to_string(list_transform(range(0, length({x}), {width}), "
            f"lambda i: substring({x}, i + 1, {width})), chr(10)) ELSE {x} END)")


PAGE_CTE = f"""{MSG_CTE},
ranked AS (SELECT loc.*, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS rn,
                  count(*) OVER (PARTITION BY user_id) AS total FROM loc),
page AS (SELECT * FROM ranked WHERE rn <= 10)"""

HISTORY_PAGE = f"""WITH {PAGE_CTE}
SELECT user_id, CAST(rn AS INTEGER) AS rn, id, local_ts,
       strftime(local_ts, '%Y-%m-%d %H:%M:%S') || chr(10) || {wrap_sql('message')} AS line,
       CAST(total AS BIGINT) AS total, CAST((total - 1) // 10 + 1 AS BIGINT) AS pages,
       false AS has_prev, (least(10, total) < total) AS has_next
FROM page"""

WEEK_EN = "'Week ' || strftime(local_ts, '%U') || ', ' || strftime(local_ts, '%Y')"

HISTORY_PERIOD = f"""WITH {MSG_CTE}
SELECT id, user_id, strftime(local_ts, '%Y-%m-%d') AS day_key, {WEEK_EN} AS week_key,
       strftime(local_ts, '%B %Y') AS month_key FROM loc"""

HISTORY_HEADERS = f"""WITH {PAGE_CTE},
k AS (SELECT user_id, rn, {WEEK_EN} AS period_key FROM page)
SELECT user_id, CAST(rn AS INTEGER) AS rn, period_key,
       CASE WHEN period_key IS DISTINCT FROM lag(period_key) OVER (PARTITION BY user_id ORDER BY rn)
            THEN chr(10) || '<b>' || period_key || '</b>' END AS header
FROM k"""

HISTORY_LATEST = """SELECT user_id, event_id AS id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events"""

LAST_SEEN = """SELECT user_id, max(ts) AS last_time FROM events GROUP BY user_id"""


# --- throttling ---------------------------------------------------------------

def recent_sql(window_seconds: int) -> str:
    return f"""SELECT event_id AS id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
       RANGE BETWEEN INTERVAL {window_seconds} SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events"""


RECENT_COUNT = recent_sql(30)
OVER_LIMIT = f"SELECT * FROM ({recent_sql(86400)}) WHERE recent > 5"


# --- text -----------------------------------------------------------------------

TEXT_BOLD = r"""SELECT conv_id, turn, regexp_replace(text, '(?s)\*\*(.*?)\*\*', '<b>\1</b>', 'g') AS text
FROM conversations"""

TEXT_BOLD_MARKED = TEXT_BOLD.replace("regexp_replace(text,", "regexp_replace(replace(text, '.', '**'),")

TEXT_WRAP50 = f"SELECT conv_id, turn, {wrap_sql('text')} AS text FROM conversations"


def chunks_sql(n: int = 4096) -> str:
    nl = "chr(10)"
    return f"""WITH RECURSIVE ch(doc_id, chunk_no, chunk, rest) AS (
  SELECT doc_id, -1, CAST(NULL AS VARCHAR), text FROM documents WHERE text IS NOT NULL AND length(text) > 0
  UNION ALL
  SELECT doc_id, chunk_no + 1, substr(rest, 1, cut), substr(rest, cut + 1)
  FROM (SELECT doc_id, chunk_no, rest,
               CASE WHEN length(rest) <= {n} THEN length(rest)
                    WHEN regexp_matches(substr(rest, 2, {n}), {nl})
                    THEN length(regexp_extract(substr(rest, 2, {n}), '(?s)^(.*)\\n', 1)) + 1
                    ELSE {n} END AS cut
        FROM ch WHERE length(rest) > 0))
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk FROM ch WHERE chunk_no >= 0"""


DOC_CHUNKS = chunks_sql(4096)


def mute_fold_sql(limit: int, window_s: int, mute_s: int, counted: str = "true") -> str:
    """The recursive spam decision as a recursive CTE (state: kept times in
    the window, mute end), one step per message of each user."""
    w, mu = window_s * 1_000_000, mute_s * 1_000_000
    return f"""WITH RECURSIVE m AS (
  SELECT user_id, event_id AS id, ts, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE {counted}),
f(user_id, rn, id, us, status, kept, muted_until) AS (
  SELECT user_id, rn, id, us, CASE WHEN 1 > {limit} THEN 'mute_start' ELSE 'ok' END, [us],
         CASE WHEN 1 > {limit} THEN us + {mu} END
  FROM m WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, id, us,
         CASE WHEN sup THEN 'suppressed' WHEN len(k2) > {limit} THEN 'mute_start' ELSE 'ok' END,
         CASE WHEN sup THEN kept ELSE k2 END,
         CASE WHEN sup THEN muted_until WHEN len(k2) > {limit} THEN us + {mu} ELSE muted_until END
  FROM (SELECT m.user_id, m.rn, m.id, m.us, f.kept, f.muted_until,
               (f.muted_until IS NOT NULL AND m.us < f.muted_until) AS sup,
               list_filter(list_append(f.kept, m.us), lambda x: x >= m.us - {w}) AS k2
        FROM f JOIN m ON m.user_id = f.user_id AND m.rn = f.rn + 1))
SELECT user_id, id, make_timestamp(us) AS timestamp, status,
       CASE WHEN status = 'mute_start' THEN make_timestamp(muted_until) END AS unmute_time
FROM f"""


MUTE_FOLD = mute_fold_sql(5, 86400, 86400)
MUTE_FOLD_COUNTED = f"""SELECT * FROM ({mute_fold_sql(3, 86400, 86400, "event_type <> 'view'")})
UNION ALL SELECT user_id, event_id, ts, 'ok', NULL FROM events WHERE event_type = 'view'"""
MUTE_INTERVALS = f"""SELECT user_id, timestamp AS mute_time, unmute_time FROM ({MUTE_FOLD})
WHERE status = 'mute_start'"""


# --- CSV scan ---------------------------------------------------------------------

CSV_CTE = """src AS (
  SELECT c.c_custkey AS k, printf('%.2f', c_acctbal) AS amt, CAST(cnt AS VARCHAR) AS cnt,
         strftime(last, '%Y-%m-%d') AS day, c_mktsegment AS seg
  FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS cnt
                             FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey),
acc AS (
  SELECT CAST(k AS VARCHAR) AS Client,
         CASE WHEN k % 53 = 0 AND k % 47 <> 0 THEN 'NA' ELSE amt END AS Amount,
         cnt AS purchase_count, day AS last_purchase,
         CASE WHEN k % 47 = 0 THEN ' a, b' ELSE seg END AS note
  FROM src WHERE k % 31 <> 0 AND k % 37 <> 0 AND k % 41 <> 0 AND k % 43 <> 0)"""

CSV_SCAN_ACCEPT = f"WITH {CSV_CTE} SELECT * FROM acc"

CSV_SCAN_REJECT = """WITH src AS (
  SELECT c.c_custkey AS k, printf('%.2f', c_acctbal) AS amt, coalesce(CAST(cnt AS VARCHAR), '') AS cnt,
         coalesce(strftime(last, '%Y-%m-%d'), '') AS day
  FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS cnt
                             FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)
SELECT CASE WHEN k % 31 = 0 THEN CAST(k AS VARCHAR) || ',' || amt
            WHEN k % 37 = 0 THEN CAST(k AS VARCHAR) || ',' || amt || ',' || cnt || ',' || day || ',x,extra'
            WHEN k % 41 = 0 THEN ''
            ELSE ',,,,' END AS raw,
       CASE WHEN k % 31 = 0 OR k % 37 = 0 THEN 'field count' ELSE 'empty row' END AS reason
FROM src WHERE k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0 OR k % 43 = 0"""

CSV_NULL_TOKENS = f"""WITH {CSV_CTE}
SELECT Client, CASE WHEN Amount = 'NA' THEN NULL ELSE Amount END AS Amount, purchase_count, last_purchase, note
FROM acc"""

ALIAS_PROJECT = f"""WITH {CSV_CTE}
SELECT Client AS client_id, CASE WHEN Amount = 'NA' THEN NULL ELSE Amount END AS amount,
       purchase_count AS frequency, last_purchase AS date FROM acc"""

PREVIEW_FIRST5 = f"""WITH {CSV_CTE}
SELECT * FROM acc ORDER BY CAST(Client AS BIGINT) LIMIT 5"""

CSV_RFM = scored_sql(f"""{CSV_CTE},
t AS (SELECT {norm_id('Client')} AS client_id, CAST(strptime(last_purchase, '%Y-%m-%d') AS TIMESTAMP) AS date,
             CASE WHEN Amount = 'NA' THEN NULL ELSE CAST(Amount AS DOUBLE) END AS amount,
             CAST(purchase_count AS DOUBLE) AS frequency FROM acc),
kept AS (SELECT *, CAST(date_diff('day', CAST(date AS DATE), DATE '{AS_OF}') AS DOUBLE) AS recency
         FROM t WHERE client_id IS NOT NULL AND date IS NOT NULL),
med AS (SELECT median(amount) AS ma, median(frequency) AS mf FROM kept),
m AS (SELECT client_id AS cid, recency, coalesce(amount, ma) AS amount, coalesce(frequency, mf) AS frequency
      FROM kept, med)""")


# --- keyed writes -------------------------------------------------------------------

USERS_CTE = f"""cur AS (
  SELECT c_custkey AS id, lower(replace(c_name, '#', '_')) AS username, split_part(c_name, '#', 1) AS first_name,
         {ZONES_CASE} AS timezone, (c_nationkey % 4 <> 0) AS timezone_set FROM customer)"""

USERS_UPSERT = f"""WITH {USERS_CTE},
chg AS (SELECT user_id AS id, arg_max('user' || CAST(user_id AS VARCHAR) || '_' || CAST(event_id AS VARCHAR), event_id) AS username,
               arg_max('Name' || CAST(user_id AS VARCHAR), event_id) AS first_name
        FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT coalesce(cur.id, chg.id) AS id, coalesce(chg.username, cur.username) AS username,
       coalesce(chg.first_name, cur.first_name) AS first_name,
       coalesce(cur.timezone, 'Europe/Moscow') AS timezone, coalesce(cur.timezone_set, false) AS timezone_set
FROM cur FULL OUTER JOIN chg ON cur.id = chg.id"""

ZONE_BY_EVENT = "CASE " + " ".join(f"WHEN event_id % {len(ADAPTER_ZONES)} = {i} THEN '{z}'"
                                   for i, z in enumerate(ADAPTER_ZONES)) + " END"

USERS_ZONE_UPDATE = f"""WITH {USERS_CTE},
chg AS (SELECT user_id AS id, arg_max({ZONE_BY_EVENT}, event_id) AS timezone
        FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT coalesce(cur.id, chg.id) AS id, cur.username, cur.first_name,
       coalesce(chg.timezone, cur.timezone, 'Europe/Moscow') AS timezone,
       CASE WHEN chg.id IS NOT NULL THEN true ELSE coalesce(cur.timezone_set, false) END AS timezone_set
FROM cur FULL OUTER JOIN chg ON cur.id = chg.id"""

HISTORY_DELETE = """SELECT event_id AS id, user_id FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 49)"""

MUTES_ACTIVE = f"""SELECT * FROM ({MUTE_INTERVALS}) WHERE unmute_time >= TIMESTAMP '2024-01-30 00:00:00'"""

SEGMENT_LOCALIZED = f"""WITH sc AS ({RFM_SEGMENTS}),
u AS (SELECT {norm_id('CAST(c_custkey AS VARCHAR)')} AS Buyer,
             CASE c_nationkey % 3 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' ELSE 'de' END AS lang_raw FROM customer)
SELECT sc.Buyer, u.lang_raw, CASE WHEN u.lang_raw IN ('ru', 'en') THEN u.lang_raw ELSE 'ru' END AS lang,
       CASE WHEN u.lang_raw = 'en' THEN {'CASE sc.Segment ' + ' '.join(f"WHEN '{r[2]}' THEN '{r[3]}'" for r in SEGMENTS) + ' END'}
            ELSE sc.Segment END AS segment_local
FROM sc JOIN u ON sc.Buyer = u.Buyer"""

HISTORY_KEYED = """SELECT event_id AS id, concat_ws(' ', event_type, props) AS message, ts AS timestamp,
  CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn
FROM events WHERE user_id = (SELECT min(user_id) FROM events)"""
STREAM_INGEST = """SELECT event_id AS id, user_id, concat_ws(' ', event_type, props) AS message, ts AS timestamp FROM events"""


# --- named steps of SURVEY §2 ---------------------------------------------------------

DROP_BAD_DATES = f"WITH {TYPED_CTE} SELECT row_key, client_id, date FROM kept"
RECENCY_FROM_DATE = f"WITH {TYPED_CTE} SELECT row_key, recency FROM kept"
CLAMP_NEGATIVE = f"""WITH {TYPED_CTE}
SELECT row_key, CASE WHEN amount < 0 THEN 0.0 ELSE amount END AS amount,
       CASE WHEN recency < 0 THEN 0.0 ELSE recency END AS recency FROM kept"""
RFM_NO_FREQUENCY = scored_sql(metrics_cte(AS_OF, frequency=False))
R_SCORE = f"SELECT Buyer, Recency, R_Score FROM ({RFM_SEGMENTS})"
F_SCORE = f"SELECT Buyer, Frequency, F_Score FROM ({RFM_SEGMENTS})"
M_SCORE = f"SELECT Buyer, Monetary, M_Score FROM ({RFM_SEGMENTS})"
SEGMENT_ASSIGN = f"""SELECT Buyer, R_Score, F_Score, M_Score, Segment FROM ({scored_sql(metrics_cte(AS_OF), lang='en')})"""
KNN_JOIN = knn_sql(["language", "segment"], 5)
HISTORY_RENDER = f"SELECT user_id, rn, line FROM ({HISTORY_PAGE})"
CORPUS_DIM_CHECK = f"""WITH {CORPUS_CTE}
SELECT language, count(*) AS vectors, CAST(min(len(embedding)) AS INTEGER) AS min_dim,
       CAST(max(len(embedding)) AS INTEGER) AS max_dim FROM c GROUP BY language"""


CSV_QUALITY_REPORT = f"""WITH {CSV_CTE},
t AS (SELECT {norm_id('Client')} AS client_id, CAST(strptime(last_purchase, '%Y-%m-%d') AS TIMESTAMP) AS date,
             CASE WHEN Amount = 'NA' THEN NULL ELSE CAST(Amount AS DOUBLE) END AS amount,
             CAST(purchase_count AS DOUBLE) AS frequency FROM acc),
kept AS (SELECT *, CAST(date_diff('day', CAST(date AS DATE), DATE '{AS_OF}') AS DOUBLE) AS recency
         FROM t WHERE client_id IS NOT NULL AND date IS NOT NULL),
med AS (SELECT median(amount) AS ma, median(frequency) AS mf FROM kept),
c AS (SELECT
  (SELECT count(*) FROM ({CSV_SCAN_REJECT})) AS lines,
  (SELECT count_if(client_id IS NULL) FROM t) AS null_id,
  (SELECT count_if(client_id IS NOT NULL AND date IS NULL) FROM t) AS bad_date,
  count_if(recency < 0) AS neg_r,
  count_if(amount IS NULL) AS null_a, count_if(coalesce(amount, (SELECT ma FROM med)) < 0) AS neg_a,
  count_if(frequency IS NULL) AS null_f, count_if(coalesce(frequency, (SELECT mf FROM med)) < 0) AS neg_f
  FROM kept)
SELECT rule, "column", CAST(n AS BIGINT) AS n FROM c, (VALUES
  ('rejected', 'lines'), ('rejected', 'null_id'), ('rejected', 'bad_date'),
  ('filled', 'recency'), ('clamped', 'recency'), ('dropped', 'recency'),
  ('filled', 'amount'), ('clamped', 'amount'), ('dropped', 'amount'),
  ('filled', 'frequency'), ('clamped', 'frequency'), ('dropped', 'frequency')) AS r(rule, "column"),
LATERAL (SELECT CASE
  WHEN rule = 'rejected' AND "column" = 'lines' THEN lines
  WHEN rule = 'rejected' AND "column" = 'null_id' THEN null_id
  WHEN rule = 'rejected' THEN bad_date
  WHEN rule = 'clamped' AND "column" = 'recency' THEN neg_r
  WHEN rule = 'filled' AND "column" = 'amount' THEN null_a
  WHEN rule = 'clamped' AND "column" = 'amount' THEN neg_a
  WHEN rule = 'filled' AND "column" = 'frequency' THEN null_f
  WHEN rule = 'clamped' AND "column" = 'frequency' THEN neg_f
  ELSE 0 END AS n) x"""


# --- layouts, labels, few values, pages ------------------------------------------------

_LAYOUTS = ["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%m/%d/%y", "%Y%m%d", "%Y-%m-%d %H:%M:%S"]
# A day-first date of which the day may be a month is read month first.
PARSE_DATE_LAYOUTS = f"""SELECT o_orderkey,
  CASE o_orderkey % {len(_LAYOUTS)} {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{x}')" for i, x in enumerate(_LAYOUTS))} END AS raw_date,
  CASE WHEN o_orderkey % {len(_LAYOUTS)} = 3 AND day(o_orderdate) <= 12 THEN CAST(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) AS TIMESTAMP)
       WHEN o_orderkey % {len(_LAYOUTS)} = 7 THEN CAST(date_trunc('second', o_orderdate) AS TIMESTAMP)
       ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS date
FROM orders"""

LABEL_FALLBACK = """SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN upper(n_name) ELSE n_name END AS label FROM nation"""


def _few_values(k: int) -> str:
    edges = ", ".join(repr(i / k) for i in range(1, k))
    return f"""SELECT {k} AS bins, Buyer, R_Score, F_Score, M_Score, {segment_case()} AS Segment FROM (
  SELECT Buyer, CAST({k} - b AS INTEGER) AS R_Score, CAST(b + 1 AS INTEGER) AS M_Score,
         CAST(greatest(1, ceil({float(k)} * (rn - 1) / (n - 1))) AS INTEGER) AS F_Score
  FROM (SELECT Buyer, n, row_number() OVER (ORDER BY v, Buyer) AS rn, len(list_filter(e, lambda x: v > x)) AS b
        FROM (SELECT 'C' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS Buyer, CAST(o_orderkey % {k} AS DOUBLE) AS v FROM orders),
             (SELECT quantile_cont(CAST(o_orderkey % {k} AS DOUBLE), [{edges}]) AS e, count(*) AS n FROM orders)))"""


SCORE_FEW_VALUES = " UNION ALL ".join(_few_values(k) for k in (2, 3, 4))

HISTORY_PAGE_DEEP = """SELECT user_id, id, rn, total FROM (
  SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
         count(*) OVER (PARTITION BY user_id) AS total FROM events)
WHERE rn BETWEEN 31 AND 40"""

HISTORY_PAGE_TEXT = chunks_sql(400).replace(
    "SELECT doc_id, -1, CAST(NULL AS VARCHAR), text FROM documents WHERE", f"""SELECT doc_id, -1, CAST(NULL AS VARCHAR), text FROM (
    WITH {PAGE_CTE},
    lines AS (SELECT user_id, rn, total, strftime(local_ts, '%Y-%m-%d') AS day,
                     strftime(local_ts, '%Y-%m-%d %H:%M:%S') || chr(10) || {wrap_sql('message')} AS line FROM page),
    headed AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY rn) AS before FROM lines)
    SELECT user_id AS doc_id, '📜 Chat history: (Страница 1 из ' || CAST((max(total) - 1) // 10 + 1 AS VARCHAR) || ')' || chr(10) || chr(10) ||
      string_agg(CASE WHEN before IS DISTINCT FROM day THEN chr(10) || '<b>' || day || '</b>' || chr(10) || chr(10) ELSE '' END || line,
                 chr(10) || chr(10) ORDER BY rn) AS text
    FROM headed GROUP BY user_id) WHERE""").replace(
    "SELECT doc_id, CAST(chunk_no", "SELECT doc_id AS user_id, CAST(chunk_no")
