"""Word and shingle expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACE_CLASS

#: The white space of the word definition, as characters to trim.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def window_hashes(w: str, n: int) -> Column:
    """64-bit hashes of the n-word windows of the array column ``w``; none if it is shorter."""
    args = ", ".join(f"get({w}, i + {k})" for k in range(n))
    return F.expr(f"CASE WHEN size({w}) >= {n} THEN transform(sequence(0, size({w}) - {n}), i -> xxhash64({args})) ELSE CAST(array() AS array<bigint>) END")


def with_shingles(rows: DataFrame, text: str, name: str, n: int = 5) -> DataFrame:
    """Add ``name``: the distinct n-word shingles as hashes; a shorter text is one shingle, one without words has none."""
    rows = rows.withColumn("__w", words(F.lower(F.col(text))))
    whole = F.expr("CASE WHEN size(__w) = 0 THEN CAST(array() AS array<bigint>) ELSE array(xxhash64(size(__w), array_join(__w, ' '))) END")
    return rows.withColumn(name, F.when(F.size("__w") >= n, F.array_distinct(window_hashes("__w", n))).otherwise(whole)).drop("__w")
