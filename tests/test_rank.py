import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from segmenter.operators import rank
from segmenter.operators.rank import rank_table, with_global_rank
from segmenter.operators.selection import exact_quantiles_many


def test_global_rank_matches_window_with_hot_key(spark):
    rows = [(i, 1 if i % 3 == 0 else i % 97) for i in range(3000)]  # one value holds a third
    df = spark.createDataFrame(rows, "id LONG, v LONG")
    got = {r["id"]: r["rank"] for r in with_global_rank(df, ["v", "id"]).collect()}
    exp = {r["id"]: r["rk"] for r in
           df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rk")).collect()}
    assert got == exp


def grouped(spark):
    rows = [(i, None if i % 11 == 0 else i % 7 if i % 2 else 0, (i * 37) % 101) for i in range(2000)]
    return spark.createDataFrame(rows, "id LONG, g LONG, v LONG")


@pytest.mark.parametrize("heavy_rows", [1_000_000, 200, 0])  # no heavy group, some, all
def test_grouped_rank_keeps_null_groups(spark, heavy_rows):
    df = grouped(spark).withColumn("_pid", F.lit("clash")).withColumn("_heavy", F.lit(1))
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id").desc())
    exp = {r["id"]: r["rk"] for r in df.select("id", F.row_number().over(w).alias("rk")).collect()}
    ranked = rank_table(df, [F.col("v").desc(), F.col("id").desc()], group="g", rank_col="rk", heavy_rows=heavy_rows).df
    assert sorted(ranked.columns) == sorted([*df.columns, "rk"])
    assert {r["id"]: r["rk"] for r in ranked.collect()} == exp


def test_rank_over_many_partitions_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(rank, "CHUNK", 4)
    df = grouped(spark)
    exp = {r["id"]: r["rk"] for r in df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rk")).collect()}
    r = rank_table(df, ["v", "id"], num_partitions=300)
    assert r.sizes == {0: 2000} and {x["id"]: x["rank"] for x in r.df.collect()} == exp
    w = Window.partitionBy("g").orderBy("v", "id")
    exp = {r["id"]: r["rk"] for r in df.select("id", F.row_number().over(w).alias("rk")).collect()}
    r = rank_table(df, ["v", "id"], group="g", num_partitions=100, heavy_rows=50)
    assert {x["id"]: x["rank"] for x in r.df.collect()} == exp


def test_rank_of_nothing(spark):
    r = rank_table(spark.createDataFrame([], "v LONG"), ["v"])
    assert r.sizes == {0: 0} and r.df.count() == 0
    assert rank_table(spark.createDataFrame([], "v LONG, g LONG"), ["v"], group="g").df.count() == 0


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=1001)
    b = np.round(rng.exponential(size=1001), 1)
    b[::5] = np.nan
    df = spark.createDataFrame([(float(x), None if np.isnan(y) else float(y)) for x, y in zip(a, b)],
                               "a DOUBLE, b DOUBLE")
    probs = [0.0, 0.2, 0.5, 0.6, 0.8, 1.0]
    got = exact_quantiles_many(df, {"a": probs, "b": probs})
    assert np.allclose(got["a"], np.quantile(a, probs), rtol=0, atol=1e-12)
    assert np.allclose(got["b"], np.quantile(b[~np.isnan(b)], probs), rtol=0, atol=1e-12)
    assert exact_quantiles_many(df.where("false"), {"a": [0.5]}) == {"a": None}


def test_partition_sizing(spark):
    from segmenter.session import partitions_for, shuffle_partitions
    from segmenter.sources.tables import table
    base = shuffle_partitions(spark)
    # In-memory frames report no usable size: the configured count is kept.
    assert partitions_for(spark.createDataFrame([(1,)], "a INT")) == base
    events = table(spark, "/root/testdata/sf0.01", "events")
    assert partitions_for(events) == base
    # A known input size scales the count; a join does not multiply it.
    assert partitions_for(events, target_bytes=10_000) > base
    joined = events.join(table(spark, "/root/testdata/sf0.01", "customer"),
                         F.col("user_id") == F.col("c_custkey"))
    assert partitions_for(joined, target_bytes=10_000) < 1_000
