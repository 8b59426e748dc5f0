"""The training-data queries over the standard tables, by name, and their SQL."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe_monoid, chat_format, html_crf, language_id, quality_mil, simhash, spotsigs, token_count, toxicity, winnowing
from seqloom.llm.batches import fold, table


def _held_out(modulus: int, remainder: int):
    return (fold("doc_id", modulus) == remainder).alias("held_out")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_monoid.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out(4, 2), "score", "predicted")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


#: A conversation whose contents look like control strings, added to the table.
CONTROL_CASE = "(-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    case = spark.sql(f"SELECT * FROM VALUES {CONTROL_CASE} AS t(conv_id, turn, role, text)")
    whole = rows.unionByName(case.select(*[F.col(c).cast(kinds[c]).alias(c) for c in rows.columns]))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return chat_format.digest_conversations(whole, path, public_tokenizers.PATTERN)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.report(winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fp_hex("fp").alias("fingerprint"), F.col("component_id").cast("long").alias("component_id"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs))
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score", "ambiguous")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality_mil.score(docs, quality_mil.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out(3, 1), "score", "predicted")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_spotsigs": op3_spotsigs,
    "op4_chat_format": op4_chat_format,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_token_count": op7_token_count,
    "op8_html_extraction": op8_html_extraction,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: Windows of eight words by plain comparison of all of them; short items have one window of their own length.
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql('text')} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, 8 AS size, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT item, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)
  UNION SELECT item, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 7),
dw AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT r, size, i, item FROM dw JOIN bw USING (size, win)),
p AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS x FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)"""


def _escaped_sql(text: str) -> str:
    """Content as it is written in the template: one more backslash inside each control string."""
    rest = [(c[0], c[1:]) for c in chat_format.CONTROL]
    for first in ("<", "["):
        names = "|".join(re.escape(c) for f, c in rest if f == first)
        text = f"regexp_replace({text}, '(\\{first})(\\\\*(?:{names}))', '\\1\\\\\\2', 'g')".replace("\\<", "<")
    return text


OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {CONTROL_CASE}) AS t(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST({sum(len(chat_format.RESERVED[i]) for i in (chat_format.BOS, chat_format.EOS))}
            + sum({sum(len(chat_format.RESERVED[i]) for i in (chat_format.TURN, chat_format.TEXT, chat_format.END))} + length({_escaped_sql('role')}) + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""

#: The others have no SQL: trained models, tokenizers' merges, XXH64 with a seed, or a fingerprint of our own.
ORACLE_SQL: dict[str, str] = {"op4_chat_format": OP4_SQL, "op5_decontamination": OP5_SQL}
