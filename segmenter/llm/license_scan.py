"""Licence scan (DataFrame operations only).

Each text passes three gates of rising cost:

1. a byte search for a handful of word stems; most texts end here;
2. the text's words are compared with the rules' keywords and with the words
   that a rule's regex cannot do without, which leaves the few rules that can
   match;
3. only those rules' regexes run, over the words joined by single blanks.

A match is an interval of words. Its place comes from the text between the
matches (``split`` and ``regexp_extract_all`` give the two in turn; the number
of blanks before a match is the index of its first word).

Overlaps: a detection is suppressed if another one with the same or a higher
priority contains its interval and is longer; of detections with the same
interval the higher priority stays, then the earlier rule. Base labels always
stay. Everything happens inside the row of the document: no shuffle, no join,
nothing depends on other documents.

Defined results: null and empty texts have no words and no labels; null and
repeated ``doc_id`` keep their rows; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .license_rules import STEMS, rules

_NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


_RULE = "struct<id:int,label:string,priority:int,keywords:array<string>,must:array<string>,regex:string,base:boolean>"


def _rules_by_keyword(known: list[dict]) -> Column:
    """The rule table as one folded literal: keyword -> its rules."""
    keywords = sorted({k for r in known for k in r["keywords"]})
    by = {k: [r for r in known if k in r["keywords"]] for k in keywords}
    return F.from_json(F.lit(json.dumps(by)), f"map<string,array<{_RULE}>>")


def _places(words: Column, rule: Column) -> Column:
    """Word intervals of a rule's matches in ``words`` (joined by blanks)."""
    matches = F.regexp_extract_all(words, rule["regex"], F.lit(0))
    gaps = F.split(words, rule["regex"], -1)
    steps = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + _blanks(x["g"])
        inside = _blanks(x["m"])
        return F.struct((first + inside).alias("at"),
                        F.concat(acc["found"], F.array(F.struct(first.alias("start"), (first + inside + 1).alias("end")))
                                 ).alias("found"))

    return F.aggregate(steps, start, step, lambda acc: acc["found"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_found (detections that stay) of every document."""
    known = rules()
    src = tk.documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    low = src.withColumn("low", F.lower("text")).withColumn("n_words", F.regexp_count("text", F.lit(_WORD)).cast("long"))
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains("low", F.lit(stem))
    gated = low.select("doc_id", "n_words", F.when(gate, F.filter(F.split("low", _NON_WORD), lambda w: w != ""))
                       .alias("tokens"))
    keywords = sorted({k for r in known for k in r["keywords"] + r["must"]})
    keyed = gated.select("doc_id", "n_words", F.array_join("tokens", " ").alias("words"),
                         F.array_intersect("tokens", F.array(*[F.lit(k) for k in keywords])).alias("keys"))
    table = _rules_by_keyword(known)
    tried = F.array_distinct(F.flatten(F.filter(
        F.transform("keys", lambda k: F.element_at(table, k)), lambda rs: rs.isNotNull())))
    tried = F.filter(tried, lambda r: F.size(F.array_except(r["must"], F.col("keys"))) == 0)
    ruled = keyed.select("doc_id", "n_words", "words", F.when(F.size("keys") > 0, tried).alias("rules"))
    found = ruled.select("doc_id", "n_words", F.coalesce(F.flatten(F.transform("rules", lambda r: F.transform(
        _places(F.col("words"), r), lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), r["priority"].alias("priority"), r["id"].alias("id"),
            r["label"].alias("label"), r["base"].alias("base"))))),
        F.array().cast("array<struct<start:int,end:int,priority:int,id:int,label:string,base:boolean>>")).alias("all"))

    def beaten(d: Column, e: Column) -> Column:
        longer = (e["start"] < d["start"]) | (e["end"] > d["end"])
        same = (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (e["id"] < d["id"]))
        return ((e["start"] <= d["start"]) & (e["end"] >= d["end"])
                & F.when(longer, e["priority"] >= d["priority"]).otherwise(same))

    kept = found.select("doc_id", "n_words", F.filter("all", lambda d: d["base"]).alias("base"), F.filter(
        "all", lambda d: ~F.exists("all", lambda e: beaten(d, e))).alias("kept"))
    base, stay = F.col("base"), F.col("kept")
    labels = F.array_sort(F.array_union(F.col("base.label"), F.col("kept.label")))
    # Evidence grows with the strongest detection's priority.
    strength = F.array_max(F.col("kept.priority"))
    score = F.when(F.size(stay) == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.pow(F.lit(0.4), strength.cast("double")))
    return kept.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).cast("long").alias("first_word"),
        F.array_max(F.col("base.start")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("base.label"))), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"), F.size(stay).cast("long").alias("n_found"))
