"""Segment summary, dominant segment, report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_LANGUAGE, LANGUAGES, SEGMENTS

# Report wording per language (the English wording is ours).
REPORT_TEXT = {
    "ru": {"title": "Результаты RFM-анализа", "customers": "Клиентов",
           "avg": "Средний чек", "total": "Общий чек", "currency": "руб."},
    "en": {"title": "RFM analysis results", "customers": "Customers",
           "avg": "Average check", "total": "Total check", "currency": "rub."},
}


def language_or_default(lang: Column) -> Column:
    """C14: unknown or missing language -> the default ("ru")."""
    return F.when(lang.isin(*LANGUAGES), lang).otherwise(F.lit(DEFAULT_LANGUAGE))


def segment_summary(scored: DataFrame, lang: str = "ru", segment_col: str = "Segment",
                    amount_col: str = "Monetary") -> DataFrame:
    """Exactly five rows in the fixed order: segment, seg_ord, customers, avg_check,
    total_check (rounded to 2; zeros for empty segments).

    One aggregation, no join: the five segment names are unioned in as
    zero-weight rows so empty segments still appear.
    """
    spark = scored.sparkSession
    idx = 2 if lang == "ru" else 3
    names = spark.createDataFrame([(r[idx], r[0]) for r in SEGMENTS], "segment STRING, seg_ord INT")
    facts = scored.select(F.col(segment_col).alias("segment"), F.col(amount_col).cast("double").alias("amt"),
                          F.lit(1).alias("one"), F.lit(None).cast("int").alias("seg_ord"))
    zeros = names.select("segment", F.lit(None).cast("double").alias("amt"), F.lit(0).alias("one"),
                         "seg_ord")
    agg = (facts.unionByName(zeros).groupBy("segment")
           .agg(F.max("seg_ord").alias("seg_ord"),
                F.sum("one").cast("long").alias("customers"),
                F.avg("amt").alias("_avg"),
                F.sum("amt").alias("_sum")))
    return (agg.where(F.col("seg_ord").isNotNull())
            .select("segment", "seg_ord", "customers",
                    F.round(F.coalesce(F.col("_avg"), F.lit(0.0)), 2).alias("avg_check"),
                    F.round(F.coalesce(F.col("_sum"), F.lit(0.0)), 2).alias("total_check"))
            .orderBy("seg_ord"))


def dominant_segment(summary: DataFrame) -> DataFrame:
    """A2: segment with most customers; ties -> first in the fixed order."""
    return summary.agg(
        F.max_by(F.col("segment"), F.struct(F.col("customers"), -F.col("seg_ord"))).alias("segment"),
        F.max("customers").alias("customers"))


def translate_segment(seg: Column, to_lang: str) -> Column:
    """Either language's name -> the name in ``to_lang``."""
    idx = 2 if to_lang == "ru" else 3
    expr = None
    for row in SEGMENTS:
        cond = seg.isin(row[2], row[3], row[1])
        expr = F.when(cond, row[idx]) if expr is None else expr.when(cond, row[idx])
    return expr


def report_text(summary: DataFrame, lang: str = "ru") -> DataFrame:
    """The text report as one row ``report`` (five segments, bounded)."""
    t = REPORT_TEXT[lang]
    line = F.format_string(
        f"%s:\n  {t['customers']}: %d\n  {t['avg']}: %.2f {t['currency']}\n  {t['total']}: %.2f {t['currency']}\n\n",
        F.col("segment"), F.col("customers"), F.col("avg_check"), F.col("total_check"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("seg_ord"), line.alias("line"))))
    return summary.agg(F.concat(F.lit(f"\n{t['title']}\n\n"),
                                F.array_join(F.transform(parts, lambda x: x["line"]), "")).alias("report"))


def extract_counts(report: DataFrame, lang: str = "ru", col: str = "report") -> DataFrame:
    """(segment, customers) pairs parsed back from report text."""
    label = REPORT_TEXT[lang]["customers"]
    pattern = rf"(?m)^([^\n:]+):\n\s+{label}: (\d+)"
    names = F.regexp_extract_all(F.col(col), F.lit(pattern), 1)
    counts = F.regexp_extract_all(F.col(col), F.lit(pattern), 2)
    return (report.select(F.posexplode(F.arrays_zip(names.alias("segment"), counts.alias("n"))).alias("pos", "z"))
            .select(F.col("z.segment").alias("segment"), F.col("z.n").cast("long").alias("customers")))


def labels_with_fallback(local: Column, default: Column) -> Column:
    """A label map where keys missing (or null) in ``local`` take the
    ``default`` language's text; keys only in ``local`` are kept."""
    return F.map_zip_with(default, local, lambda k, d, loc: F.coalesce(loc, d))
