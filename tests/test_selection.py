"""Selection of order statistics against sorted lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmenter.operators import selection
from segmenter.operators.selection import Selection
from segmenter.session import cut_lineage

RANKS = [1, 2, 1000, 1999, 2000, 2500, 4000, 4500, 4999, 5000]


def column(kind: str) -> list:
    rng = np.random.default_rng(3)
    n = 5000
    return {"normal": rng.normal(size=n), "constant": np.full(n, 7.0), "two values": rng.integers(0, 2, n) * 1.0,
            "hot": np.where(rng.random(n) < 0.4, 3.0, rng.exponential(size=n) * 5), "whole": np.floor(rng.exponential(size=n) * 40),
            "wide": np.exp(rng.normal(size=n) * 80) * rng.choice([-1, 1], n), "ends": np.r_[-math.inf, rng.normal(size=n - 3), math.inf, -0.0],
            }[kind].tolist()


@pytest.mark.parametrize("kind", ["normal", "constant", "two values", "hot", "whole", "wide", "ends"])
@pytest.mark.parametrize("two_steps", [False, True])
def test_ranks_of_a_column(spark, kind, two_steps, monkeypatch):
    if two_steps:
        monkeypatch.setattr(selection, "FAN", 2)
    values = column(kind)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 20, "v DOUBLE").repartition(8)
    sel = Selection(df, {"v": ("v", None)}, small=5)  # small: many passes
    assert sel.two_steps == two_steps and sel.n["v"] == len(values)
    got = sel.at({"v": RANKS})["v"]
    assert {r: v for r, (v, _) in got.items()} == {r: sorted(values)[r - 1] for r in RANKS}
    assert sel.passes < 15
    assert sel.distinct(5)["v"] == min(5, len(set(values)))


def test_a_sketch_that_is_off_does_no_harm(spark, monkeypatch):
    """Whatever items a sketch gives, the counts of the cells decide."""
    values = column("normal")
    counted = Selection._pass

    def off(self, ends):
        cells = counted(self, ends)
        for c in (c for cs in cells.values() for c in cs if c.grid):
            c.grid = c.grid[self.passes * 97 % 400:][:4] * 129
        return cells

    monkeypatch.setattr(Selection, "_pass", off)
    sel = Selection(spark.createDataFrame([(v,) for v in values], "v DOUBLE"), {"v": ("v", None)}, small=500)
    got = sel.at({"v": [1, 17, 2500, 5000]})["v"]
    assert {r: v for r, (v, _) in got.items()} == {r: sorted(values)[r - 1] for r in (1, 17, 2500, 5000)}


def test_ranks_inside_ties(spark):
    rng = np.random.default_rng(4)
    texts = ["", "a", "a\0", "a\0\0\0\0", "a\0\0\0\0\0", "abcde", "abcdef", "abcdefghij", "abcdefghijk", "Ünïcödé tëxt", "日本語", "z" * 40]
    rows = [(float(rng.integers(0, 3)), texts[rng.integers(len(texts))] + ("" if i % 3 else f"-{i:05d}")) for i in range(3000)]
    rows += [(math.nan, f"n{i}") for i in range(50)]
    sel = Selection(spark.createDataFrame(rows, "v DOUBLE, t STRING").repartition(5), {"v": ("v", "t")}, small=7)
    want = sorted(rows, key=lambda r: (math.isnan(r[0]), 0 if math.isnan(r[0]) else r[0], r[1].encode()))
    ranks = [1, 2, 3, 400, 900, 1000, 1500, 2000, 2400, 2999, 3000, 3001, 3025, 3050]
    got = sel.at({"v": ranks})["v"]
    for r in ranks:
        v, t = want[r - 1]
        assert got[r][1] == t and (got[r][0] == v or math.isnan(v) and math.isnan(got[r][0]))
    with pytest.raises(ValueError):
        sel.at({"v": [3051]})


def test_passes_over_the_rows_only(spark):
    df = spark.range(0, 300_000, 1, 8).select((F.rand(5) * 1e6).alias("a"), F.floor(F.rand(6) * 50).cast("double").alias("b"),
                                               F.col("id").cast("string").alias("t"))
    df = cut_lineage(df, "selection")
    sel = Selection(df, {"a": ("a", None), "b": ("b", "t")})
    got = sel.at({"a": [1, 150_000, 300_000], "b": [60_000, 120_000]})
    assert sel.passes <= 7
    a = sorted(r["a"] for r in df.select("a").collect())
    b = sorted((r["b"], r["t"]) for r in df.select("b", "t").collect())
    assert [got["a"][r][0] for r in (1, 150_000, 300_000)] == [a[0], a[149_999], a[-1]]
    assert [got["b"][r] for r in (60_000, 120_000)] == [b[59_999], b[119_999]]


def test_ties_are_read_off_in_few_passes(spark):
    from segmenter.operators.score import plan_scores
    df = spark.range(20_000).selectExpr("cast(id % 2 as double) v", "concat('C', lpad(cast(id as string), 12, '0')) t")
    sel = Selection(df, {"v": ("v", "t")}, small=64)
    assert sel.at({"v": [1, 5000, 10_001]}) == {"v": {1: (0.0, f"C{0:012d}"), 5000: (0.0, f"C{9998:012d}"), 10_001: (1.0, f"C{1:012d}")}}
    assert sel.passes <= 9  # a level of the text that all rows share takes one pass
    sent, at = [], Selection.at
    Selection.at = lambda self, ranks: sent.append(dict(ranks)) or at(self, ranks)
    try:
        plan = plan_scores(df, "v", "v", "v", "t")
    finally:
        Selection.at = at
    assert (plan.route, plan.f_bins, plan.f_bounds) == ("fallback", 2, [(0.0, f"C{19998:012d}")])
    assert [r["F"] for r in sent if "F" in r] == [[10_000]]  # the ranks of five bins, which nothing reads, are not looked for
