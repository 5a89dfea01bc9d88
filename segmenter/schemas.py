"""Schemas, fixed value tables and small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being matched; do not edit).
# ---------------------------------------------------------------------------

# Canonical column -> accepted header names (compared after strip + lower).
COLUMN_ALIASES: dict[str, list[str]] = {
    "client_id": ["id", "number", "номер", "client", "клиент", "buyer", "покупатель",
                  "customerid", "customer", "userid", "clientid"],
    "recency": ["recency", "давность", "dayssincelastpurchase", "days_since_last_purchase"],
    "amount": ["amount", "сумма", "cost", "стоимость", "price", "цена", "monetary", "деньги",
               "totalspent", "total_spent"],
    "frequency": ["frequency", "частота", "purchasecount", "purchase_count"],
    "date": ["date", "дата", "transaction_date", "last_purchase"],
}
CANONICAL_ORDER = ["client_id", "recency", "amount", "frequency", "date"]

# Segments in their fixed report order: (order, code, Russian name, English name).
SEGMENTS = [
    (1, "VIP", "VIP-клиенты", "VIP Customers"),
    (2, "Loyal", "Лояльные клиенты", "Loyal Customers"),
    (3, "New", "Новые покупатели", "New Customers"),
    (4, "At-Risk", "Рискующие клиенты", "At-Risk Customers"),
    (5, "Lost", "Спящие клиенты", "Lost Customers"),
]

# Tokens read as missing by the CSV re-parse (the pandas default NA list).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# Operating constants.
DEFAULT_TIMEZONE = "Europe/Moscow"
DEFAULT_LANGUAGE = "ru"
LANGUAGES = ["ru", "en"]
PAGE_SIZE = 10
SEARCH_LIMIT = 3
MESSAGE_PART_LIMIT = 4096
WRAP_WIDTH = 50
RATE_LIMIT = 15
RATE_WINDOW_SECONDS = 30
MUTE_SECONDS = 30

# Period header words for the week key, per language.
WEEK_WORD = {"en": "Week", "ru": "Неделя"}

# ---------------------------------------------------------------------------
# Struct types.
# ---------------------------------------------------------------------------

CANONICAL_SCHEMA = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("recency", T.DoubleType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("frequency", T.DoubleType()),
    T.StructField("date", T.TimestampNTZType()),
])

USERS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("username", T.StringType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("timezone", T.StringType()),
    T.StructField("timezone_set", T.BooleanType()),
])

MESSAGES_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

MUTES_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("mute_time", T.TimestampNTZType()),
    T.StructField("unmute_time", T.TimestampNTZType()),
])

LAST_SEEN_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("last_time", T.TimestampNTZType()),
])

CORPUS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("segment", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def segment_dim(spark: SparkSession) -> DataFrame:
    """Five-row segment dimension: seg_ord, seg_code, name_ru, name_en."""
    return spark.createDataFrame(
        SEGMENTS, "seg_ord INT, seg_code STRING, name_ru STRING, name_en STRING")
