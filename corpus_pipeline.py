"""A corpus pipeline: toxicity, quality rules, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run()
writes every stage as Parquet in the shared folder and reads it again.

Every stage takes null texts as empty, whole texts of any length, and an empty table (whose
result is empty); all but the last return the columns of their input, whatever these are
called, and may be given documents with more columns. What is a stage's own is in its docstring. Training, iterated components and
BPE have no SQL form, so there is no SQL for run(); tests compare with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, jaccard_join, rules, toxicity
from cairn.llm.common import without
from cairn.session import cut, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. Rows are judged one by one: repeated rows stay or go together, a null id or text is scored like any other."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are judged one by one; a null or empty text has too few words and goes; a null id is judged like any other."""
    return rules.keep_good(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of linked documents the one with the smallest id.

    Of rows that share the surviving id one stays (that of the least hash of its text), so no exact
    copy survives; documents without an id, or without words, are linked with nothing and stay.
    """
    found = cut(jaccard_join.join_documents(docs))
    rest = without(docs, found.where("component_id <> doc_id").select("doc_id"), "doc_id")
    repeated = cut(found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return rest
    again = rest.join(repeated, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = again.groupBy("doc_id").agg(F.min_by("row", "h").alias("row")).select("row.*")
    return without(rest, repeated, "doc_id").unionByName(one)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Rows that share an id go together if one of them leaks; rows without an id are told apart by their texts.
    """
    key = F.when(F.col("doc_id").isNull(), F.concat(F.lit("text "), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))).otherwise(F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    keyed = docs.withColumn("__key", key)
    leaks = decontaminate.find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="__key")
    return without(keyed, leaks.select("__key"), "__key").drop("__key")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text. Repeated rows and null ids stay; a null or empty text has no tokens."""
    encoded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    tokens = F.expr("CAST(octet_length(ids_le) DIV 4 AS BIGINT)").alias("n_tokens")
    return encoded.select("doc_id", tokens, "ids_le", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_rules", reject_low_quality),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encode_decode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
