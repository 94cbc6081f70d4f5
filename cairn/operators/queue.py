"""An at-least-once work queue with tiers and leases, as batch transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tiers of the queue.
AMBIENT, MATCHED, FRESH = 0, 1, 2


def enqueue_unanalyzed(items: DataFrame, analyzers: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """(item, analyzer, priority, enqueued_at, leased_until) for every pair without a result. ``analyzers`` is a short list."""
    pairs = items.select("item").distinct().withColumn("analyzer", F.explode(F.array(*[F.lit(r[0]) for r in analyzers.select("analyzer").distinct().collect()])))
    left = pairs.join(done.select("item", "analyzer"), ["item", "analyzer"], "left_anti")
    return left.select("item", "analyzer", F.lit(AMBIENT).alias("priority"), F.lit(now).cast("long").alias("enqueued_at"), F.lit(0).cast("long").alias("leased_until"))


def promote(queue: DataFrame, more: DataFrame) -> DataFrame:
    """Merge rows by (item, analyzer): the highest priority, the first enqueue time, the last lease."""
    return queue.unionByName(more).groupBy("item", "analyzer").agg(F.max("priority").alias("priority"), F.min("enqueued_at").alias("enqueued_at"), F.max("leased_until").alias("leased_until"))


def bump(queue: DataFrame, matched: DataFrame) -> DataFrame:
    """Raise items that a catalog names to the matched tier."""
    hit = matched.select("item").distinct().withColumn("__hit", F.lit(MATCHED))
    return queue.join(hit, "item", "left").withColumn("priority", F.greatest("priority", F.coalesce("__hit", F.lit(AMBIENT)))).drop("__hit")


def claim(queue: DataFrame, analyzer: str, limit: int, now: int, lease: int, blocked_by: list[str] = (), resident: DataFrame | None = None) -> DataFrame:
    """The next ``limit`` items for an analyzer: free, not held back by an analyzer of a lower class, in queue order."""
    mine = queue.where((F.col("analyzer") == analyzer) & (F.col("leased_until") <= now))
    if blocked_by:
        mine = mine.join(queue.where(F.col("analyzer").isin(*blocked_by)).select("item").distinct(), "item", "left_anti")
    if resident is not None:
        mine = mine.join(resident.select("item").distinct(), "item", "left_semi")
    top = mine.orderBy(F.desc("priority"), "enqueued_at", "item").limit(limit)
    return top.withColumn("leased_until", F.lit(now + lease).cast("long"))


def lease(queue: DataFrame, claimed: DataFrame) -> DataFrame:
    """The queue with the claimed rows' leases set."""
    c = claimed.select("item", "analyzer", F.col("leased_until").alias("__until"))
    return queue.join(c, ["item", "analyzer"], "left").withColumn("leased_until", F.coalesce("__until", "leased_until")).drop("__until")


def renew(queue: DataFrame, held: DataFrame, now: int, lease: int) -> DataFrame:
    """The queue with the leases of held(item, analyzer) prolonged; a lease that nobody has is not made."""
    mine = held.select("item", "analyzer").distinct().withColumn("__mine", F.lit(True))
    prolonged = F.when(F.col("__mine") & (F.col("leased_until") > 0), F.lit(now + lease)).otherwise(F.col("leased_until"))
    return queue.join(mine, ["item", "analyzer"], "left").withColumn("leased_until", prolonged.cast("long")).drop("__mine")


def release(queue: DataFrame, which: Column) -> DataFrame:
    return queue.withColumn("leased_until", F.when(which, F.lit(0)).otherwise(F.col("leased_until")).cast("long"))


def complete(queue: DataFrame, done: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, done) after results(item, analyzer, outcome): negatives are recorded too."""
    rest = queue.join(results.select("item", "analyzer"), ["item", "analyzer"], "left_anti")
    kept = done.join(results.select("item", "analyzer"), ["item", "analyzer"], "left_anti").unionByName(results)
    return rest, kept


def absent_eligible(grounded: DataFrame, named: DataFrame, mode: str) -> DataFrame:
    """Absent items that may be analysed: none, those grounded and named by a catalog, or all grounded."""
    if mode == "off":
        return grounded.limit(0)
    return grounded if mode == "all" else grounded.join(named.select("item").distinct(), "item", "left_semi")
