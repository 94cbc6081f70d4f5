"""A ledger of jobs, an exclusive guard, and the rounds that work a queue off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import queue as Q
from cairn.session import cut

# Job states.
RUNNING, DONE, FAILED, INTERRUPTED = 0, 1, 2, 3


def insert(ledger: DataFrame, jobs: DataFrame) -> DataFrame:
    """The ledger(job, kind, state, started, finished) with new rows; a job id that is known is an error of the caller and ignored."""
    return ledger.unionByName(jobs.join(ledger.select("job"), "job", "left_anti").select(*ledger.columns))


def finalize(ledger: DataFrame, ended: DataFrame) -> DataFrame:
    """The ledger after ended(job, state, finished); only running jobs end."""
    e = ended.select("job", F.col("state").alias("__state"), F.col("finished").alias("__at"))
    hit = F.col("__state").isNotNull() & (F.col("state") == RUNNING)
    joined = ledger.join(e, "job", "left")
    return joined.withColumn("finished", F.when(hit, F.col("__at")).otherwise(F.col("finished"))).withColumn("state", F.when(hit, F.col("__state")).otherwise(F.col("state"))).select(*ledger.columns)


def interrupt_running(ledger: DataFrame, now: int) -> DataFrame:
    """What a start finds running was cut off."""
    running = F.col("state") == RUNNING
    return ledger.withColumn("finished", F.when(running, F.lit(now).cast("long")).otherwise(F.col("finished"))).withColumn("state", F.when(running, INTERRUPTED).otherwise(F.col("state")))


def newest_finished(ledger: DataFrame) -> DataFrame:
    """(kind, job, finished): the last job of each kind that ended well."""
    last = ledger.where(F.col("state") == DONE).groupBy("kind").agg(F.max(F.struct("finished", "job")).alias("x"))
    return last.select("kind", "x.job", "x.finished")


def recent(ledger: DataFrame, n: int) -> DataFrame:
    """The last ``n`` jobs by start, oldest first."""
    return ledger.orderBy(F.desc("started"), F.desc("job")).limit(n).orderBy("started", "job")


def claim_guard(guard: DataFrame, holder: str, now: int, lease: int) -> tuple[DataFrame, bool]:
    """(guard, granted): a table of one row (holder, until) or none. Free, expired, or the holder's own (then renewed)."""
    row = guard.first()
    granted = row is None or row["until"] <= now or row["holder"] == holder
    if not granted:
        return guard, False
    return guard.sparkSession.createDataFrame([(holder, now + lease)], "holder string, until long"), True


def release_guard(guard: DataFrame, holder: str) -> DataFrame:
    return guard.where(F.col("holder") != holder)


def sweep(queue: DataFrame, classes: list[list[str]], analyze: Callable[[DataFrame], DataFrame], limit: int, now: int, lease: int = 600) -> tuple[DataFrame, DataFrame]:
    """(queue, results) when rounds have worked off what can be worked off.

    ``classes``: analyzers by class; an item waits for an analyzer of a later class until those of earlier classes are done with it. A
    round claims up to ``limit`` items for every analyzer, runs ``analyze`` (rows -> item, analyzer, outcome) and records
    all outcomes, negative ones too. It ends when a round claims nothing.
    """
    done = queue.select("item", "analyzer", F.lit(0).alias("outcome")).limit(0)
    while True:
        claimed = []
        for place, names in enumerate(classes):
            before = [n for earlier in classes[:place] for n in earlier]
            claimed += [Q.claim(queue, name, limit, now, lease, before) for name in names]
        taken = cut(claimed[0] if len(claimed) == 1 else _all(claimed))
        if taken.isEmpty():
            return queue, done
        rest, done = Q.complete(queue, done, analyze(taken))
        queue, done = cut(rest), cut(done)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def kept_jobs(ledger: DataFrame, keep: int) -> DataFrame:
    """The ledger without finished jobs beyond the newest ``keep`` of each kind."""
    w = Window.partitionBy("kind", (F.col("state") == RUNNING)).orderBy(F.desc("started"), F.desc("job"))
    return ledger.withColumn("__n", F.row_number().over(w)).where((F.col("state") == RUNNING) | (F.col("__n") <= keep)).drop("__n")
