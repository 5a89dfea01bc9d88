"""Q8: file or table -> clean -> score -> segment -> summary.

Driver work is limited to small statistics: one aggregation of counters, a
median per column that has gaps, five or six edge values per measure and the
partition row counts of the distributed rank. The customer-level table is
checkpointed once after cleaning so the statistics jobs and the scoring job
read it instead of recomputing its lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataQualityError
from ..operators.clean import CleanResult, clean_customers
from ..operators.columns import with_default
from ..operators.score import ScorePlan, assign_segment, plan_scores, score
from ..operators.summary import segment_summary


@dataclass
class RfmResult:
    scored: DataFrame
    summary: DataFrame
    plan: ScorePlan
    cleaning: CleanResult


def to_rfm_frame(clean: DataFrame, *keep: str) -> DataFrame:
    """Canonical clean frame -> Buyer, Recency, Monetary, Frequency (default 1), and the columns to ``keep``."""
    df = with_default(clean, "frequency", 1.0)
    if "recency" not in df.columns or "amount" not in df.columns:
        raise DataQualityError("scoring needs recency and amount")
    return df.select(F.col("client_id").alias("Buyer"), F.col("recency").alias("Recency"),
                     F.col("amount").alias("Monetary"), F.col("frequency").alias("Frequency"), *keep)


def analyze(canonical: DataFrame, as_of: str | None = None, lang: str = "ru",
            phone_only: bool = False, tie_break: str = "Buyer") -> RfmResult:
    """Scores and segments of every row. Frequency ties go by ``tie_break``, then
    by a row number stored with the typed table, so rows that repeat an id are
    ranked one by one."""
    cleaning = clean_customers(canonical.withColumn("_row", F.monotonically_increasing_id()), as_of=as_of,
                               phone_only=phone_only, passthrough=("_row",))
    row = F.lpad(F.col("_row").cast("string"), 20, "0")
    base = to_rfm_frame(cleaning.df, "_row").withColumn("_tie", F.concat_ws("\0", F.col(tie_break).cast("string"), row))
    cleaning.df = cleaning.df.drop("_row")
    plan = plan_scores(base, tie_break="_tie")
    if plan.n == 0:
        raise DataQualityError("no rows left after cleaning")
    scored = assign_segment(score(base, plan, tie_break="_tie"), lang)
    scored = scored.select("Buyer", "Recency", "Monetary", "Frequency",
                           "R_Score", "F_Score", "M_Score", "Segment")
    return RfmResult(scored, segment_summary(scored, lang), plan, cleaning)
