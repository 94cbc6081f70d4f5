"""Ranked choices: best of a family, newest of a source, budgets, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.functions.columns import with_suffix
from cairn.session import cut, release


def best_of(rows: DataFrame, family: list[str], order: list[Column]) -> DataFrame:
    """The first row of each family. Give a total order: ties would be arbitrary."""
    w = Window.partitionBy(*family).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def best_struct(rows: DataFrame, family: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """best_of() for ascending orders by one partial aggregation: no family is ever gathered or sorted."""
    least = F.min(F.struct(*order, *carry)).alias("best")
    return rows.groupBy(*family).agg(least).select(*family, *(F.col(f"best.{c}").alias(c) for c in [*order, *carry]))


def newest(rows: DataFrame, source: list[str], order: list[Column], keep: int = 2) -> DataFrame:
    """Rows with their rank per source and whether retention keeps them."""
    w = Window.partitionBy(*source).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("kept", F.col("rank") <= keep)


def numbered(rows: DataFrame, order: list[Column], name: str = "n", buckets: int = 64) -> DataFrame:
    """Add 1, 2, 3, ... in a total order, without one task that sees all rows: numbers inside range partitions, on top of their sizes before."""
    ranged = cut(rows.repartitionByRange(buckets, *order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__s"))
    before = sizes.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.join(F.broadcast(before), "__p").withColumn(name, inside + F.col("__before")).drop("__p", "__before")  # ``buckets`` rows


def one_game_one_rom(candidates: DataFrame, regions: list[str], languages: list[str], strict: bool = False, clonelist: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """The preferred candidate of every family: (family, entry) of candidates(entry, name, cloneof, required, held).

    Families: the clone list's group (by full name in lower case, else by base name); else, where any candidate of the
    catalog names a parent, the parent or the entry itself; else the base name. The best of a family is, in this order, fully held
    (unless ``strict``), no development version, of the first region and language, of the highest revision, first by name. ``group``:
    a column that tells catalogs apart, each judged for itself.
    """
    by = [group] if group else []
    rows = candidates.withColumn("__full", F.lower("name")).withColumn("__base", C.base_name(F.col("name")))
    by = by or ["__all"]
    rows, candidates = rows.withColumn("__all", F.lit(0)), candidates.withColumn("__all", F.lit(0))
    rows = rows.join(candidates.groupBy(*by).agg((F.count("cloneof") > 0).alias("__cloned")), by)  # a row for each catalog
    listed = F.lit(None).cast("string")
    if clonelist is not None:
        terms = clonelist.groupBy("term").agg(F.min("group").alias("__g"))
        rows = rows.join(terms.select(F.col("term").alias("__full"), F.col("__g").alias("__g1")), "__full", "left").join(terms.select(F.col("term").alias("__base"), F.col("__g").alias("__g2")), "__base", "left")
        listed = F.coalesce("__g1", "__g2")
    family = F.when(listed.isNotNull(), F.concat(F.lit("group:"), listed)).when(F.col("__cloned"), F.concat(F.lit("entry:"), F.coalesce("cloneof", "entry").cast("string"))).otherwise(F.concat(F.lit("name:"), F.col("__base")))
    tokens = C.paren_tokens(F.col("name"))
    lowered = F.transform(tokens, lambda x: F.lower(x))
    missing = F.lit(0) if strict else F.when((F.col("required") > 0) & (F.col("held") == F.col("required")), 0).otherwise(1)
    regions, languages = [C.REGION_ALIASES.get(r.lower(), r.lower()) for r in regions], [x.lower() for x in languages]
    scored = rows.select(*by, family.alias("family"), missing.alias("__s0"), C.is_dev(tokens).cast("int").alias("__s1"), C.axis_rank(C.region_tokens(tokens), regions).alias("__s2"), C.axis_rank(lowered, languages).alias("__s3"), (-C.revision(tokens)).alias("__s4"), F.col("name").alias("__s5"), "entry")
    return best_struct(scored, [*by, "family"], [f"__s{i}" for i in range(6)], ["entry"]).select(*([group] if group else []), "family", "entry")


def prune(rows: DataFrame, running: Column, order: list[Column], keep: int, by: list[str]) -> DataFrame:
    """Drop finished rows beyond the newest ``keep`` of each group; running ones are never dropped."""
    w = Window.partitionBy(*by, running).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(running | (F.col("__n") <= keep)).drop("__n")


def within_budget(rows: DataFrame, size: str, order: list[str], reclaim: int, buckets: int = 256) -> DataFrame:
    """Rows to drop, in order, until ``reclaim`` bytes are freed: those whose prior running sum is below it.

    A global running sum without one giant sort task: rows are range-partitioned
    by the order, each partition's total is found first, and a window runs inside
    each partition on top of the totals before it. ``order``: "col" or "-col".
    """
    keys = [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]
    ranged = cut(rows.repartitionByRange(buckets, *keys).withColumn("__p", F.spark_partition_id()))
    sums = ranged.groupBy("__p").agg(F.sum(size).alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.join(F.broadcast(before.select("__p", "__before")), "__p")  # ``buckets`` rows
    run = run.withColumn("freed_before", F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.col("__before"))
    return run.where(F.col("freed_before") < reclaim).drop("__p", "__before")


def settle_paths(rows: DataFrame, path: str, other: str, order: list[Column], keep: str | None = None) -> DataFrame:
    """Give each row its path, or its other path if an earlier row has taken that, or none: (..., final_path).

    Rows claim in order, as if one by one. ``keep``: a column with a path to fall back on where both are taken; without it such
    rows are dropped. A few rounds over the rows, since a row may lose its path to the other path of an earlier one.
    """
    now = cut(rows.withColumn("__t", F.lit(0)).withColumn("final_path", F.col(path)))
    while True:
        rank = F.row_number().over(Window.partitionBy("final_path").orderBy(*order))
        losers = F.when(F.col("__t") < 2, rank > 1).otherwise(False)
        ranked = now.withColumn("__lost", losers.cast("int"))
        step = F.col("__t") + F.col("__lost")
        last = F.col(keep) if keep else F.lit(None).cast("string")
        seen = Observation()
        moved = ranked.select(*[c for c in now.columns if c not in ("__t", "final_path")], step.alias("__t"), F.when(step == 0, F.col(path)).when(step == 1, F.col(other)).otherwise(last).alias("final_path"), "__lost").observe(seen, F.coalesce(F.sum("__lost"), F.lit(0)).alias("n"))
        old, now = now, cut(moved.drop("__lost"))
        release(old)
        if not seen.get.get("n", 0):
            return now.where("final_path IS NOT NULL").drop("__t")


def number_collisions(rows: DataFrame, path: str, order: list[Column], suffix: Column) -> DataFrame:
    """The first claimant of a path keeps it, later ones get the suffix before the extension; whoever still collides is dropped."""
    return settle_paths(rows.withColumn("__other", with_suffix(F.col(path), suffix)), path, "__other", order).drop("__other")
