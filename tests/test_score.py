import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmenter.operators.score import assign_segment, plan_scores, score, segment_code


# The segment of every score triple. Key: R; one word for each F
# from 1 to 5, one letter for each M from 1 to 5.
GOLDEN = {
    1: "XXXAA XXAAA XAAAA AAAAA AAAAA",
    2: "XXXAA XXAAA XAAAA AAAAA AAAAL",
    3: "AAAAA AAAAA AAAAA AAAAL AAALL",
    4: "NNNAN NNANN NANNL ANNLL NNLLL",
    5: "NNNNN NNNNL NNNLL NNLLL NLLLV",
}
NAMES = {"V": "VIP", "L": "Loyal", "N": "New", "X": "Lost", "A": "At-Risk"}


def test_truth_table_125(spark):
    combos = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(combos, "R INT, F INT, M INT")
    got = {(r["R"], r["F"], r["M"]): r["c"] for r in
           df.select("R", "F", "M", segment_code(F.col("R"), F.col("F"), F.col("M")).alias("c")).collect()}
    assert got == {(r, f, m): NAMES[GOLDEN[r].split()[f - 1][m - 1]] for r, f, m in combos}
    counts = pd.Series(list(got.values())).value_counts().to_dict()
    assert counts == {"At-Risk": 63, "New": 30, "Loyal": 19, "Lost": 12, "VIP": 1}


def frame(spark, rec, mon, freq=None):
    freq = freq or [1.0] * len(rec)
    rows = [(f"c{i:04d}", float(r), float(m), float(f)) for i, (r, m, f) in enumerate(zip(rec, mon, freq))]
    return spark.createDataFrame(rows, "Buyer STRING, Recency DOUBLE, Monetary DOUBLE, Frequency DOUBLE")


def scores(spark, rec, mon, freq=None):
    df = frame(spark, rec, mon, freq)
    plan = plan_scores(df)
    out = score(df, plan).orderBy("Buyer").collect()
    return plan, [r["R_Score"] for r in out], [r["F_Score"] for r in out], [r["M_Score"] for r in out]


def test_quintiles_1_to_10(spark):
    plan, r, f, m = scores(spark, list(range(1, 11)), list(range(1, 11)), list(range(1, 11)))
    assert plan.route == "main"
    assert r == [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]
    assert m == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert f == m


def test_fallback_two_bins(spark):
    plan, r, f, m = scores(spark, [1, 1, 2, 2], [1, 1, 2, 2])
    assert plan.route == "fallback"
    assert r == [2, 2, 1, 1] and m == [1, 1, 2, 2] and f == [1, 1, 1, 1]


def test_fallback_repeated_edges_constant(spark):
    plan, r, f, m = scores(spark, [1, 1, 1, 1, 1, 1, 2, 3], [1, 1, 1, 1, 1, 1, 2, 3])
    assert plan.route == "fallback" and set(r) == {1} and set(m) == {1}


def test_single_row(spark):
    plan, r, f, m = scores(spark, [5], [7])
    assert (r, f, m) == ([1], [1], [1])


@pytest.mark.parametrize("n", [2, 3, 7, 16, 41, 100])
def test_against_pandas_qcut(spark, n):
    rnd = random.Random(n)
    rec = [rnd.randint(0, 400) + rnd.random() for _ in range(n)]
    mon = [rnd.random() * 1000 for _ in range(n)]
    freq = [float(rnd.randint(1, 4)) for _ in range(n)]
    plan, r, f, m = scores(spark, rec, mon, freq)
    pdf = pd.DataFrame({"Buyer": [f"c{i:04d}" for i in range(n)], "R": rec, "M": mon, "F": freq})
    exp_r = pd.qcut(pdf["R"], 5, labels=[5, 4, 3, 2, 1]).astype(int).tolist()
    exp_m = pd.qcut(pdf["M"], 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    ranked = pdf.sort_values(["F", "Buyer"]).assign(rk=range(1, n + 1)).sort_index()["rk"]
    exp_f = pd.qcut(ranked, 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert (r, m, f) == (exp_r, exp_m, exp_f)


def test_assign_segment_names(spark):
    df = spark.createDataFrame([(5, 5, 5), (1, 1, 1)], "R_Score INT, F_Score INT, M_Score INT")
    assert [r["Segment"] for r in assign_segment(df, "en").collect()] == ["VIP Customers", "Lost Customers"]
    assert [r["Segment"] for r in assign_segment(df, "ru").collect()] == ["VIP-клиенты", "Спящие клиенты"]


def test_missing_frequency_defaults_to_one(spark):
    from segmenter.plans.rfm import analyze
    rows = [(f"id{i}", str(i), str(10 * i)) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "client_id STRING, recency STRING, amount STRING")
    res = analyze(df)
    out = res.scored.orderBy("Buyer").collect()
    assert {r["Frequency"] for r in out} == {1.0}
    # Constant frequency: the main route bins the first-come rank (tie-break: the id).
    assert sorted(r["F_Score"] for r in out) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert res.summary.count() == 5


@pytest.mark.parametrize("tie_break", ["Buyer", "Recency"])
def test_rows_that_repeat_an_id_are_ranked_one_by_one(spark, tie_break):
    from segmenter.plans.rfm import analyze
    rows = [("A" if i <= 6 else f"B{i}", str(i), str(10 * i)) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "client_id STRING, recency STRING, amount STRING")
    res = analyze(df, tie_break=tie_break)
    assert sorted(r["F_Score"] for r in res.scored.collect()) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert "_row" not in res.cleaning.df.columns
