from segmenter.operators.clean import clean_customers


def test_median_before_clamp(spark):
    df = spark.createDataFrame([("a", None), ("b", "-10"), ("c", "20"), ("d", "30")],
                               "client_id STRING, amount STRING").withColumn("recency", __import__(
                                   "pyspark.sql.functions", fromlist=["lit"]).lit("1"))
    res = clean_customers(df)
    got = {r["client_id"]: r["amount"] for r in res.df.collect()}
    assert got == {"a": 20.0, "b": 0.0, "c": 20.0, "d": 30.0}
    assert res.medians["amount"] == 20.0
    assert res.counts["filled:amount"] == 1 and res.counts["clamped:amount"] == 1


def test_all_null_measure_drops_rows(spark):
    df = spark.createDataFrame([("a", None, "1"), ("b", None, "2")], "client_id STRING, amount STRING, recency STRING")
    res = clean_customers(df)
    assert res.df.count() == 0 and res.counts["dropped:amount"] == 2


def test_null_ids_dropped_and_dates(spark):
    df = spark.createDataFrame([(None, "2024-01-31", "5"), ("8 (900) 1", "hello", "5"), ("x", "2024-01-31", "5")],
                               "client_id STRING, date STRING, amount STRING")
    res = clean_customers(df, as_of="2024-02-10")
    rows = res.df.collect()
    assert [(r["client_id"], r["recency"]) for r in rows] == [("x", 10.0)]
    assert res.counts["rejected:null_id"] == 1 and res.counts["rejected:bad_date"] == 1
