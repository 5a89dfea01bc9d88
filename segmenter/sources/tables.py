"""Table access and the adapters that turn the supplied tables into the
reference's inputs (customer metrics, message log, users, recommendation corpus).

Adapters are plain projections / aggregations over the supplied parquet tables,
so their work grows with the tables. They are ours, not reference operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values for the adapters.
AS_OF = "2001-08-02"
AS_OF_TIED = "2001-01-01"
# Zone of an adapted user, chosen by c_nationkey % 4.
ADAPTER_ZONES = ["Europe/Moscow", "UTC", "America/New_York", "Asia/Tokyo"]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def customer_metrics(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """One row per customer from ``orders``: client_id, recency (days from the
    last order to ``as_of``, negative for orders after it), amount (sum of
    order totals, 2 decimals), frequency (order count)."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy("o_custkey")
            .agg(F.max("o_orderdate").alias("_last"),
                 F.round(F.sum("o_totalprice"), 2).alias("amount"),
                 F.count(F.lit(1)).cast("double").alias("frequency"))
            .select(F.col("o_custkey").cast("string").alias("client_id"),
                    F.datediff(F.lit(as_of).cast("date"), F.to_date("_last")).cast("double").alias("recency"),
                    "amount", "frequency"))


def tied_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order from ``lineitem`` with heavily tied measures:
    recency = max line number, amount = sum of extended prices, frequency = lines."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_orderkey")
            .agg(F.max("l_linenumber").cast("double").alias("recency"),
                 F.round(F.sum("l_extendedprice"), 2).alias("amount"),
                 F.count(F.lit(1)).cast("double").alias("frequency"))
            .select(F.col("l_orderkey").cast("string").alias("client_id"), "recency", "amount", "frequency"))


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as messy text columns (client_id, amount, frequency, date),
    dirtied by fixed deterministic rules on the key so an SQL oracle can mirror
    them: phone-style and hyphenated ids, missing ids, number words, NA tokens,
    three date layouts and unparseable dates. Every customer row is kept."""
    c = table(spark, sf_dir, "customer")
    o = (table(spark, sf_dir, "orders").groupBy("o_custkey")
         .agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("cnt")))
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    k = F.col("c_custkey")
    key = k.cast("string")
    client_id = (F.when(k % 23 == 0, F.lit(None).cast("string"))
                 .when(k % 2 == 0, F.concat(F.lit("8 (900) "), key, F.lit("-45-67")))
                 .otherwise(F.concat(F.lit("C-"), key)))
    amount = (F.when(k % 17 == 0, F.lit(None).cast("string"))
              .when(k % 19 == 0, F.lit("two hundred five"))
              .when(k % 13 == 0, F.lit("n/a"))
              .when(k % 11 == 0, F.lit("twenty-one"))
              .otherwise(F.col("c_acctbal").cast("string")))
    frequency = (F.when(k % 7 == 0, F.lit("NA"))
                 .when(k % 5 == 0, F.concat(F.lit(" "), F.col("cnt").cast("string"), F.lit(" ")))
                 .otherwise(F.col("cnt").cast("string")))
    d = F.col("last")
    date = (F.when(k % 29 == 0, F.lit("unknown"))
            .when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(k % 3 == 1, F.date_format(d, "dd.MM.yyyy"))
            .otherwise(F.date_format(d, "MM/dd/yyyy")))
    return j.select(k.alias("row_key"), client_id.alias("client_id"), amount.alias("amount"),
                    frequency.alias("frequency"), date.alias("date"))


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as the message history: id, user_id, message, timestamp (UTC)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id",
                    F.concat_ws(" ", "event_type", "props").alias("message"),
                    F.col("ts").alias("timestamp"))


def zone_expr(nationkey) -> "F.Column":
    expr = None
    for i, z in enumerate(ADAPTER_ZONES):
        expr = F.when(nationkey % len(ADAPTER_ZONES) == i, z) if expr is None \
            else expr.when(nationkey % len(ADAPTER_ZONES) == i, z)
    return expr


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as the users table: id, username, first_name, timezone, timezone_set."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"),
                    F.lower(F.regexp_replace("c_name", "#", "_")).alias("username"),
                    F.split("c_name", "#").getItem(0).alias("first_name"),
                    zone_expr(F.col("c_nationkey")).alias("timezone"),
                    (F.col("c_nationkey") % 4 != 0).alias("timezone_set"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as the recommendation corpus: label plays the segment,
    vec_id parity the language."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("label").cast("string").alias("segment"),
                    F.when(F.col("vec_id") % 2 == 0, "ru").otherwise("en").alias("language"),
                    F.concat(F.lit("recommendation "), F.col("vec_id").cast("string")).alias("recommendation"),
                    "embedding")


def requests_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``embeddings`` row as a search request: request_id, language,
    segment, query_vec, query_text."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("request_id"),
                    F.when(F.col("vec_id") % 2 == 0, "ru").otherwise("en").alias("language"),
                    F.col("label").cast("string").alias("segment"),
                    F.col("embedding").alias("query_vec"),
                    F.concat(F.lit("request "), F.col("vec_id").cast("string")).alias("query_text"))


# Header of the customer CSV written by ``write_customer_csv`` (exercises the
# alias table: case, spaces, a synonym and an unknown column).
CSV_HEADER = "Client, Amount ,purchase_count,last_purchase,note"


def customer_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as one CSV text line, broken by fixed rules on the key:
    short and long rows, blank lines, empty rows, quoted commas, NA tokens and
    leading spaces. Column ``value`` holds the line."""
    c = table(spark, sf_dir, "customer")
    o = (table(spark, sf_dir, "orders").groupBy("o_custkey")
         .agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("cnt")))
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    k = F.col("c_custkey")
    key = k.cast("string")
    amt = F.format_string("%.2f", F.col("c_acctbal"))
    cnt = F.coalesce(F.col("cnt").cast("string"), F.lit(""))
    day = F.coalesce(F.date_format("last", "yyyy-MM-dd"), F.lit(""))
    line = (F.when(k % 31 == 0, F.concat_ws(",", key, amt))
            .when(k % 37 == 0, F.concat_ws(",", key, amt, cnt, day, F.lit("x"), F.lit("extra")))
            .when(k % 41 == 0, F.lit(""))
            .when(k % 43 == 0, F.lit(",,,,"))
            .when(k % 47 == 0, F.concat_ws(",", key, amt, cnt, day, F.lit('" a, b"')))
            .when(k % 53 == 0, F.concat_ws(",", key, F.lit("NA"), cnt, day, F.col("c_mktsegment")))
            .otherwise(F.concat_ws(",", key, F.concat(F.lit(" "), amt), cnt, day, F.col("c_mktsegment"))))
    return j.select(line.alias("value"))


def write_customer_csv(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Write ``customer_csv_lines`` as text part files, lines verbatim, each file
    starting with the header line (one per partition, added as the partition
    is streamed out). Returns the folder."""
    import pandas as pd

    header = CSV_HEADER

    def with_header(batches):
        yield pd.DataFrame({"value": [header]})
        for b in batches:
            yield b

    customer_csv_lines(spark, sf_dir).mapInPandas(with_header, "value STRING") \
        .write.mode("overwrite").text(path)
    return path
