"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import (bpe, chat_format, decontaminate, fptree_search, hilbert, interpolated_lm, jaccard_join, license_scan, pq_neardup,
               suffix_dedup, textkit, tokenpack, toxicity, whitening)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenpack.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                    textkit.crc_mod("doc_id", 4) == 2)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(table(spark, sf_dir, "documents"))


def op6_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return interpolated_lm.score_documents(docs, textkit.crc_mod("doc_id", 7) == 2)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op8_pq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_neardup.link_vectors(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"),
                                public_tokenizers.PATTERN)


def op11_fptree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# A conversation whose texts are control strings, beside those of the table.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("byte_bpe_50k.json")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
                                    "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    report = chat_format.read_back(chat_format.format_conversations(conversations, path), path)
    return report.drop("n_tokens", "loss_tokens")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_license_scan, op2_token_files, op3_decontaminate, op4_toxicity, op5_hilbert_shards, op6_interpolated_lm,
    op7_suffix_dedup, op8_pq_neardup, op9_jaccard_join, op10_byte_bpe, op11_fptree_search, op12_chat_format, op13_whitening)}

RANKED_SEARCH = r"""WITH t AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
doc AS (SELECT d, doc_id, ws, len(ws) AS n FROM t WHERE len(ws) > 0),
g AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nw FROM doc),
item AS (
  SELECT r, item_id, term, count(*) AS c FROM (
    SELECT r, item_id, unnest(ws) AS term FROM (
      SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark))
  GROUP BY r, item_id, term),
tf AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ws) AS term FROM doc)
  WHERE term IN (SELECT term FROM item) GROUP BY d, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, nd),
part AS (
  SELECT tf.d, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * doc.n * g.nd) // g.nw))) AS s
  FROM tf JOIN w USING (term) JOIN doc USING (d), g),
score AS (
  SELECT item.r, item.item_id, part.d, CAST(sum(item.c * part.s) AS BIGINT) AS score
  FROM item JOIN part USING (term) GROUP BY item.r, item.item_id, part.d),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM score JOIN doc USING (d) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""

CHAT_FORMAT = rf"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({sum(map(len, chat_format.MARKS))} + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

ORACLE_SQL: dict[str, str] = {"op11_fptree_search": RANKED_SEARCH, "op12_chat_format": CHAT_FORMAT}
