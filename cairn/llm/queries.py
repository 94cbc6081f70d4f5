"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, decontaminate, html_text, jaccard_join, ngram_lm, quality, rules, token_counts, toxicity
from cairn.session import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"))


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def lm_base_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 says of every text besides the model's own score: the columns that SQL can check."""
    own = op2_lm_scoring(spark, sf_dir)
    return own.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def quality_base_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 counts in every text: the columns that SQL can check."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def crc32_sql(text: str) -> str:
    """crc32 of a text of ASCII characters in DuckDB's SQL, byte by byte through a table."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        table.append(c)
    octets = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {octets}), lambda a, x: xor(a >> 8, CAST([{', '.join(map(str, table))}][(xor(a, x) & 255) + 1] AS BIGINT))), 4294967295)"


_WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: In DuckDB's SQL; the end of a text is the empty word.
LM_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWER)} AS w, coalesce({crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 1, false) AS held_out FROM documents),
tok AS (SELECT r, doc_id, held_out, unnest(list_append(w, '')) AS t FROM d),
c AS (SELECT t, count(*) FILTER (WHERE NOT held_out) AS n FROM tok GROUP BY t),
s AS (SELECT sum(n) AS total, count(*) FILTER (WHERE n > 0) AS kinds FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE n > 0) AS n_known, CAST(total AS BIGINT) AS train_tokens, round(sum(log10((n + 0.5) / (total + 0.5 * (kinds + 1)))), 6) AS base_score
FROM tok JOIN c USING (t) CROSS JOIN s GROUP BY r, doc_id, held_out, total
"""

RULES_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
wins AS (SELECT r, i, array_to_string(w[i:i+2], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d) x),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM wins) x WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM twice) x GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) x WHERE regexp_matches(l, '[^ \t\n\x0b\x0c\r]') GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
"""

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_extraction": op4_html_extraction,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "lm_base_measures": lm_base_measures,
    "quality_base_measures": quality_base_measures,
}

ORACLES: dict[str, str] = {
    "op5_chat_formatting": chat.ORACLE,
    "op8_benchmark_decontamination": decontaminate.ORACLE,
    "lm_base_measures": LM_ORACLE,
    "quality_base_measures": RULES_ORACLE,
}
