"""The work queue fed by a stream of events: idempotent ingest and micro-batch merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.queue import promote


def read_events(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once; ids are remembered for as long as a repeat may be late, so state stays bounded."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def merge_into_queue(events: DataFrame, as_queue_rows, folder: str, checkpoint: str, compact_every: int = 20) -> StreamingQuery:
    """Run all available events through foreachBatch: each micro-batch adds a small table of its own rows, named by its number.

    Rows of one item merge by promote(), which does not mind in how many tables they stand, so a batch reads nothing of
    the queue; every ``compact_every`` batches the tables are merged into one and removed. A repeated batch writes the same
    table again. A single writer owns the folder; read_queue() gives the queue as it stands.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = as_queue_rows(batch)
        promote(rows, rows.limit(0)).write.mode("overwrite").parquet(f"{folder}/batch-{number:09d}")
        if number % compact_every == compact_every - 1:
            old = _tables(batch.sparkSession, folder)
            _queue(batch.sparkSession, old).write.mode("overwrite").parquet(f"{folder}/merged-{number:09d}")
            _remove(batch.sparkSession, old)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The queue as it stands after the last batch."""
    return _queue(spark, _tables(spark, folder))


def _queue(spark: SparkSession, tables: list[str]) -> DataFrame:
    rows = spark.read.parquet(*tables)
    return promote(rows, rows.limit(0))


def _tables(spark: SparkSession, folder: str) -> list[str]:
    """The tables that hold the queue: the last merged one, and batches after it. What was merged already but not yet removed does not count."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = sorted(str(f.getPath()) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))
    number = lambda p: int(p.rpartition("-")[2])
    merged = [p for p in found if "/merged-" in p and _complete(spark, p)]
    last = merged[-1:]
    return [*last, *(p for p in found if "/batch-" in p and (not last or number(p) > number(last[0])))]


def _complete(spark: SparkSession, table: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _remove(spark: SparkSession, tables: list[str]) -> None:
    for table in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """An extension: events per type and tumbling event-time window, with late data bounded by a watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
