"""Small pieces that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.session import cut

#: The white space of the word definition, as bytes.split() has it too.
SPACE_CLASS = r"[ \t-\r]"


def fold_is(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32(id as text) mod modulus = remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % F.lit(modulus) == F.lit(remainder), F.lit(False))


#: Bytes of an Arrow batch handed to Python, at most, unless one row is larger: texts can be very long.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes: one value for all operators, and a smaller one that the session sets is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def thrifty(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back at the end of a task: workers wait for the next one beside the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def give_back() -> None:
    """Return freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is a C library that can
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """mapInArrow with a batch-to-batch function."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(thrifty(run), schema)


def without(rows: DataFrame, keys: DataFrame, key: str, most_broadcast: int = 500_000) -> DataFrame:
    """Rows whose ``key`` is not among ``keys`` (one column); rows with a null key stay.

    A list of up to ``most_broadcast`` keys is broadcast, so that the rows are not shuffled.
    """
    listed = cut(keys.toDF(key).where(F.col(f"`{key}`").isNotNull()).distinct())
    n = listed.count()
    return rows.join(F.broadcast(listed) if n <= most_broadcast else listed, key, "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns)) if n else rows


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def uniform(column: Column, salt: int = 0) -> Column:
    """A number in [0, 1) fixed by the value: for documented, repeatable samples."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
