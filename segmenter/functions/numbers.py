"""Free text to number, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English number words and their values.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40,
    "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000,
}

# A plain decimal literal; anything else (1d, inf, nan, 0x1) is not a number.
_NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _word_map(words: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.lit(float(v)))])


def strip_unicode(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_to_number(c: Column | str, words: dict[str, int] | None = None) -> Column:
    """Parse a number from text: a decimal literal, else English number words.

    ``"1_000"`` -> 1000, ``"1e3"`` -> 1000, ``"two hundred five"`` -> 205,
    ``"twenty-one"`` -> 21, ``"two point five"`` -> 2.5,
    ``"about two dollars"`` -> 2 (unknown words are
    ignored), ``"1d"``/``"nan"``/``"inf"``/``"два"`` -> null. Numeric input is
    passed through (NaN and infinities become null).
    """
    c = F.col(c) if isinstance(c, str) else c
    wmap = _word_map(words or NUMBER_WORDS)
    s = F.lower(strip_unicode(c.cast("string")))
    s = F.regexp_replace(s, r"(?<=[0-9])_(?=[0-9])", "")
    as_number = F.when(s.rlike(_NUMERIC), s.try_cast("double"))
    tokens = F.split(F.regexp_replace(s, "-", " "), r"(?U)\s+")
    # "point": words after it are decimal digits ("two point five" -> 2.5).
    at = F.array_position(tokens, F.lit("point")).cast("int")
    whole = F.when(at > 0, F.slice(tokens, 1, F.greatest(at - 1, F.lit(0)))).otherwise(tokens)
    frac = F.when(at > 0, F.slice(tokens, at + 1, F.size(tokens))).otherwise(F.array().cast("array<string>"))
    digits = F.filter(F.transform(frac, lambda t: F.element_at(wmap, t)), lambda v: v.isNotNull() & (v < 10))
    decimals = F.when(F.size(digits) > 0, F.concat(F.lit("0."), F.array_join(
        F.transform(digits, lambda v: v.cast("int").cast("string")), "")).cast("double")).otherwise(F.lit(0.0))
    known = F.filter(whole, lambda t: F.map_contains_key(wmap, t))

    def step(acc, t):
        v = F.element_at(wmap, t)
        cur = acc["cur"]
        tot = acc["tot"]
        new_cur = (F.when(v == 100, F.greatest(cur, F.lit(1.0)) * 100)
                   .when(v >= 1000, F.lit(0.0))
                   .otherwise(cur + v))
        new_tot = F.when(v >= 1000, tot + F.greatest(cur, F.lit(1.0)) * v).otherwise(tot)
        return F.struct(new_tot.alias("tot"), new_cur.alias("cur"))

    folded = F.aggregate(known, F.struct(F.lit(0.0).alias("tot"), F.lit(0.0).alias("cur")), step,
                         lambda acc: acc["tot"] + acc["cur"])
    from_words = F.when((F.size(known) > 0) | (F.size(digits) > 0), folded + decimals)
    out = F.coalesce(as_number, from_words)
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), F.lit(None).cast("double")).otherwise(out)
