"""Dates and period keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date formats, tried in this order (month first for
# ambiguous slashed or dashed dates, day first where that is no date), each with the shape a value must have before
# the parser is tried (parse failures are expensive; shape checks are not).
_D = r"[0-9]{1,2}"
DATE_FORMATS = [
    (rf"^[0-9]{{4}}-{_D}-{_D}$", "yyyy-M-d"),
    (rf"^[0-9]{{4}}/{_D}/{_D}$", "yyyy/M/d"),
    (rf"^[0-9]{{4}}\.{_D}\.{_D}$", "yyyy.M.d"),
    (rf"^{_D}/{_D}/[0-9]{{4}}$", "M/d/yyyy"),
    (rf"^{_D}/{_D}/[0-9]{{4}}$", "d/M/yyyy"),
    (rf"^{_D}/{_D}/[0-9]{{2}}$", "M/d/yy"),
    (rf"^{_D}/{_D}/[0-9]{{2}}$", "d/M/yy"),
    (rf"^{_D}-{_D}-[0-9]{{4}}$", "M-d-yyyy"),
    (rf"^{_D}-{_D}-[0-9]{{4}}$", "d-M-yyyy"),
    (rf"^{_D}\.{_D}\.[0-9]{{4}}$", "d.M.yyyy"),
    (rf"^{_D}\.{_D}\.[0-9]{{2}}$", "d.M.yy"),
    (r"^[0-9]{8}$", "yyyyMMdd"),
    (rf"^{_D} [A-Za-z]{{3}} [0-9]{{4}}$", "d MMM yyyy"),
    (rf"^{_D} [A-Za-z]{{4,9}} [0-9]{{4}}$", "d MMMM yyyy"),
    (rf"^[A-Za-z]{{3}} {_D}, [0-9]{{4}}$", "MMM d, yyyy"),
    (rf"^[A-Za-z]{{4,9}} {_D}, [0-9]{{4}}$", "MMMM d, yyyy"),
]
# A date, then perhaps a time: hour, minute, second with fraction, AM/PM, zone.
_WITH_TIME = (rf"^(.*?[0-9])(?:(?:T| +)({_D}):({_D})(?::({_D}(?:\.[0-9]{{1,9}})?))? ?([AaPp][Mm])?"
              r" ?(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2})?)?$")


def _century(t: Column, fmt: str) -> Column:
    """Two-digit years 69 to 99 are of the 1900s, 00 to 68 of the 2000s."""
    if "yyyy" in fmt:
        return t
    return F.when(F.year(t) >= 2069, t - F.expr("INTERVAL 100 YEARS")).otherwise(t)


def parse_date(c: Column | str, formats: list[tuple[str, str]] | None = None) -> Column:
    """First date format that parses wins; a time may follow any of them. A zone
    is passed over: the value is the wall-clock time as written. Nothing parses,
    or an hour, minute or second out of range -> null (counted by C7)."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c.cast("string"))
    date, h, m, sec, half = (F.regexp_extract(s, _WITH_TIME, i) for i in range(1, 6))
    # The date text is found once a row and bound to ``d``, not repeated in every try.
    day = F.transform(F.array(date), lambda d: F.coalesce(*[
        F.when(d.rlike(shape), _century(F.try_to_timestamp(d, F.lit(fmt)), fmt)) for shape, fmt in (formats or DATE_FORMATS)]))
    day = day[0].cast("timestamp_ntz")
    hour, minute = h.try_cast("int"), m.try_cast("int")
    second = F.coalesce(sec.try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
    in_range = F.when(half == "", hour <= 23).otherwise(hour.between(1, 12)) & (minute <= 59) & (second < 60)
    hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0))
    at = F.make_dt_interval(F.lit(0), hour, minute, second)
    return F.when(h == "", day).when(in_range, day + at)


def recency_days(date_col: Column | str, as_of: dt.date | str) -> Column:
    """Whole days from the date part of ``date_col`` to ``as_of`` (may be negative)."""
    date_col = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.datediff(F.lit(str(as_of)).cast("date"), F.to_date(date_col)).cast("double")


def week_of_year_sunday(ts: Column) -> Column:
    """``strftime('%U')``: weeks start on Sunday, days before the first Sunday are week 0."""
    return F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7).cast("int")


def period_key(ts: Column, period: str | None, lang: str | Column = "en") -> Column:
    """Group label for a local timestamp: day ``yyyy-MM-dd``, week ``Week 05, 2024``
    (``Неделя`` in Russian), month ``January 2024``; None -> null."""
    if period is None:
        return F.lit(None).cast("string")
    if period == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if period == "week":
        lang_c = F.lit(lang) if isinstance(lang, str) else lang
        word = F.when(lang_c == "en", F.lit("Week")).otherwise(F.lit("Неделя"))
        return F.concat(word, F.lit(" "), F.lpad(week_of_year_sunday(ts).cast("string"), 2, "0"),
                        F.lit(", "), F.date_format(ts, "yyyy"))
    if period == "month":
        return F.date_format(ts, "MMMM yyyy")
    raise ValueError(f"unknown period {period!r}")
