"""Q1-Q7: quintile scores and segment assignment.

A few aggregation passes (``selection.Selection``) over the three measures give
every number the scores need: the R and M quantile edges, for F the (Frequency,
tie-break) keys at the rank boundaries of the bins, and how many different
values a measure has, up to five. Nothing is sorted or written for them.
Scoring is then a single projection with those few values as literals: no join, no shuffle,
no per-row Python. F is the bin of a first-come rank r (ties broken by the
tie-break column), ``greatest(1, ceil(k*(r-1)/(n-1)))``; row r lies above the
boundary of bin i exactly when its key is greater than the key at rank
``1 + floor(i*(n-1)/k)``.

Route (as the reference): five bins for all three measures; if any of the three
has repeated edges, all three are recomputed with ``k = min(5, distinct)`` bins;
fewer than two distinct values, or still repeated edges -> score 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEGMENTS
from .selection import Selection, interpolate, quantile_positions


def bins_probs(k: int) -> list[float]:
    return [i / k for i in range(k + 1)]


def strictly_increasing(edges: list[float] | None) -> bool:
    return edges is not None and all(a < b for a, b in zip(edges, edges[1:]))


def rank_boundaries(n: int, k: int) -> list[int]:
    """Last rank of bins 1..k-1 when ranks 1..n are cut into k equal-count bins."""
    return [1 + (i * (n - 1)) // k for i in range(1, k)]


def bucket_expr(x: Column, edges: list[float]) -> Column:
    """1-based bin of ``x`` for right-closed bins with the lowest edge included."""
    expr = F.lit(1)
    for e in edges[1:-1]:
        expr = expr + F.when(x > F.lit(float(e)), 1).otherwise(0)
    return expr


def key_bucket_expr(value: Column, tie: Column, bounds: list[tuple[float, str]]) -> Column:
    """1 + number of boundary keys that (value, tie) exceeds, lexicographically."""
    expr = F.lit(1)
    for bv, bt in bounds:
        above = (value > F.lit(float(bv))) | ((value == F.lit(float(bv))) & (tie > F.lit(bt)))
        expr = expr + F.when(above, 1).otherwise(0)
    return expr


@dataclass
class ScorePlan:
    """What the driver decided from the statistics pass (inspectable in tests)."""
    n: int
    route: str = "main"
    r_bins: int = 5
    f_bins: int = 5
    m_bins: int = 5
    r_edges: list[float] | None = None
    m_edges: list[float] | None = None
    f_bounds: list[tuple[float, str]] | None = None
    notes: list[str] = field(default_factory=list)


def _stats(sel: Selection, bins: dict[str, int]) -> dict[str, list | None]:
    """The edges of R and M and the boundary keys of F for so many bins."""
    ranks = {}
    for name, k in bins.items():
        n = sel.n[name]
        if n:
            ranks[name] = (rank_boundaries(n, k) if name == "F"
                           else [r for lo, hi, _ in quantile_positions(n, bins_probs(k)) for r in (lo, hi)])
    found = sel.at(ranks)
    out: dict[str, list | None] = dict.fromkeys(bins)
    for name, rs in ranks.items():
        if name == "F":
            out[name] = [found[name][r] for r in rs]
        else:
            out[name] = interpolate({r: v for r, (v, _) in found[name].items()}, sel.n[name], bins_probs(bins[name]))
    return out


def plan_scores(df: DataFrame, recency: str = "Recency", monetary: str = "Monetary",
                frequency: str = "Frequency", tie_break: str = "Buyer") -> ScorePlan:
    cols = {"R": recency, "M": monetary, "F": frequency}
    sel = Selection(df, {"R": (recency, None), "M": (monetary, None), "F": (frequency, tie_break)})
    n = sel.n["R"]
    plan = ScorePlan(n=n)
    if n == 0:
        return plan
    ks = sel.distinct(5)
    whole = {"R": 5, "M": 5, "F": 5}
    # Few values seldom have five bins: then F, whose ranks go by the tie texts, waits for the route.
    early = whole if ks["R"] == ks["M"] == 5 or n < 2 else {"R": 5, "M": 5}
    first = _stats(sel, early)
    main = n >= 2 and strictly_increasing(first["R"]) and strictly_increasing(first["M"])
    if "F" not in first and (main or ks["F"] == 5):
        first |= _stats(sel, {"F": 5})
    if main:
        plan.r_edges, plan.m_edges, plan.f_bounds = first["R"], first["M"], first["F"]
        return plan
    plan.route = "fallback"
    need = {k: ks[k] for k in cols if 2 <= ks[k] < 5 and not (k == "F" and n < 2)}
    second = _stats(sel, need) if need else {}
    for k in ("R", "M"):
        edges = (first[k] if ks[k] == 5 else second.get(k)) if ks[k] >= 2 else None
        if not strictly_increasing(edges):
            plan.notes.append(f"{cols[k]}: constant score")
            edges, ks[k] = None, 1
        setattr(plan, f"{k.lower()}_edges", edges)
        setattr(plan, f"{k.lower()}_bins", ks[k])
    if ks["F"] >= 2 and n >= 2:
        plan.f_bounds = first["F"] if ks["F"] == 5 else second["F"]
        plan.f_bins = ks["F"]
    else:
        plan.f_bins = 1
        plan.notes.append(f"{frequency}: constant score")
    return plan


def score(df: DataFrame, plan: ScorePlan | None = None, tie_break: str = "Buyer",
          recency: str = "Recency", monetary: str = "Monetary", frequency: str = "Frequency") -> DataFrame:
    """Add R_Score, F_Score, M_Score (INT) in one projection."""
    plan = plan or plan_scores(df, recency, monetary, frequency, tie_break)
    r = F.lit(1) if plan.r_edges is None else \
        F.lit(plan.r_bins + 1) - bucket_expr(F.col(recency), plan.r_edges)
    m = F.lit(1) if plan.m_edges is None else bucket_expr(F.col(monetary), plan.m_edges)
    f = F.lit(1) if plan.f_bounds is None else \
        key_bucket_expr(F.col(frequency).cast("double"), F.col(tie_break).cast("string"), plan.f_bounds)
    return (df.withColumn("R_Score", r.cast("int"))
            .withColumn("F_Score", f.cast("int"))
            .withColumn("M_Score", m.cast("int")))


def segment_code(r: Column, f: Column, m: Column) -> Column:
    """Bands of the three scores: all 5 VIP; a sum of 12 or more Loyal; recent
    customers (R 5, or 4 unless F+M is 5) New; long gone with F+M of 4 or less
    Lost; all others At-Risk."""
    fm = f + m
    return (F.when(r + fm == 15, "VIP")
            .when(r + fm >= 12, "Loyal")
            .when((r == 5) | ((r == 4) & (fm != 5)), "New")
            .when((r <= 2) & (fm <= 4), "Lost")
            .otherwise("At-Risk"))


def segment_name(code: Column, lang: str = "ru") -> Column:
    idx = 2 if lang == "ru" else 3
    expr = None
    for row in SEGMENTS:
        expr = (F.when(code == row[1], row[idx]) if expr is None
                else expr.when(code == row[1], row[idx]))
    return expr


def assign_segment(df: DataFrame, lang: str = "ru") -> DataFrame:
    code = segment_code(F.col("R_Score"), F.col("F_Score"), F.col("M_Score"))
    return df.withColumn("Segment", segment_name(code, lang))
