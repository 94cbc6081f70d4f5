"""The registry's tables, filled by the modules registry*.py."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cairn.session import TABLES, table

QUERIES: dict = {}
ORACLES: dict = {}

#: Rows that one task takes of a table that is dealt by a key.
ROWS_A_TASK = 100_000

_USED = re.compile(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame by its name, with SQL for the same rows where there is any."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """All rows, dealt by a key into parts of about ROWS_A_TASK, which adaptive execution does not merge again.

    What groups, joins or makes distinct by that key then needs no other shuffle, and no task
    sorts more rows when the table grows.
    """
    return rows.repartition(max(1, -(-rows.count() // ROWS_A_TASK)), key)


def fixture(spark: SparkSession, sf: str, sql: str, keys: dict[str, str] | None = None) -> DataFrame:
    """Rows of a SELECT over the driver's tables that Spark and the SQL for comparison share: what stands in for an operator's input.

    ``keys``: tables that are dealt() by a key first.
    """
    for name in {found[2] for found in _USED.finditer(sql)}:
        rows = table(spark, sf, name)
        if keys and name in keys:
            rows = dealt(rows, keys[name])
        rows.createOrReplaceTempView(f"cairn_{name}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sha256(x STRING) RETURNS STRING RETURN sha2(x, 256)")
    return spark.sql(_USED.sub(r"\1 cairn_\2", sql).replace("VARCHAR", "STRING").replace("chr(92)", "char(92)"))
