"""Corpus pipeline: five stages over ``documents``, each written as Parquet to
the shared checkpoint folder and read again by the next.

=================  ==========================================================
toxicity           documents that score as toxic go
near_duplicates    of each group of linked texts (five-word shingles,
                   similarity 0.8 or more) the one with the smallest id stays
repeated_passages  byte strings of 400 or more and runs of 51 or more words that
                   occur elsewhere are cut out
decontamination    documents that hold a benchmark window go
tokens             byte-level BPE ids of what is left
=================  ==========================================================

All stages but the last return the columns of ``documents``. ``n_chars`` is set
anew where a text was cut. Rows with a null id are never grouped; of rows that
repeat id and text one stays, and where an id repeats with several texts each is
judged by itself. Empty tables pass through every stage.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmenter.llm import bpe, decontaminate, jaccard_join, suffix_dedup, textkit, toxicity
from segmenter.operators.columns import free_names
from segmenter.session import cut_lineage, ship_package
from segmenter.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), textkit.crc_mod("doc_id", 4) == 2)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    first = jaccard_join.first_of_groups(docs, 5, Fraction(4, 5))
    of, text_hash, mark, copy = free_names(docs, "_of", "_text_hash", "_mark", "_copy")
    kept = (docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
            .join(first.select(F.col("doc_id").alias(of), F.col("text_hash").alias(text_hash)),
                  (F.col("doc_id") == F.col(of)) & (F.col(mark) == F.col(text_hash)), "left_semi"))
    # Of rows that repeat id and text, the one whose columns hash lowest.
    same = Window.partitionBy("doc_id", mark).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    one = kept.withColumn(copy, F.row_number().over(same)).where(F.col(copy) == 1)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return one.select(*names).unionByName(docs.where("doc_id is null").select(*names))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    cut = suffix_dedup.dedup_texts(docs, words=51)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship_package(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_passages", cut_repeats),
          ("decontamination", drop_contaminated), ("tokens", encode)]

# No SQL: several stages (learned scores, BPE) have none; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of ``documents`` after all stages, as token digests."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
