from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from segmenter.operators.history import history_page, history_page_deep
from segmenter.sources.tables import message_log


def test_second_page_matches_brute_force(spark):
    m = message_log(spark, SF_SMALL)
    rows = [(r["user_id"], r["id"], r["timestamp"]) for r in m.collect()]
    got = {(r["user_id"], r["rn"]): (r["id"], r["total"], r["pages"], r["has_prev"], r["has_next"])
           for r in history_page(m, page=1, page_size=3).collect()}
    exp = {}
    by_user = {}
    for u, i, t in rows:
        by_user.setdefault(u, []).append((t, i))
    for u, items in by_user.items():
        items.sort(reverse=True)
        total = len(items)
        for rn, (_, i) in enumerate(items[3:6], start=4):
            exp[(u, rn)] = (i, total, (total - 1) // 3 + 1, True, min(6, total) < total)
    assert got == exp


def test_deep_page_of_a_hot_user_sends_few_rows(spark):
    """Page 1,000 of a user with 30,000 messages: the rows of one bucket are ranked."""
    rows = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, null, 7) as user_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) as timestamp")
    rows = rows.unionByName(spark.createDataFrame([(99_999, 7, None)], "id LONG, user_id INT, timestamp TIMESTAMP_NTZ"))
    page = history_page_deep(rows, 1000, 10)
    w = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    exp = rows.withColumn("rn", F.row_number().over(w)).where("rn between 10001 and 10010")
    assert {(r["user_id"], r["id"], r["rn"]) for r in page.collect()} == {(r["user_id"], r["id"], r["rn"]) for r in exp.collect()}
    assert {r["total"] for r in page.select("total").distinct().collect()} == {20_001}
