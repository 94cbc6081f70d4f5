"""Content store tables: digests, dedup, aliases, shards, compaction, review of orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.columns import hash_sample


def digests(rows: DataFrame, content: Column) -> DataFrame:
    """All digests and the size of a content column in one projection."""
    return (
        rows.withColumn("size", F.octet_length(content).cast("long"))
        .withColumn("crc32", F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0"))
        .withColumn("md5", F.md5(content))
        .withColumn("sha1", F.sha1(content))
        .withColumn("sha256", F.sha2(content, 256))
    )


def insert_missing(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Insert-or-ignore: rows of ``incoming`` whose key is new, one per key."""
    return existing.unionByName(incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti"))


def bulk_insert(rows: DataFrame, folder: str, by: str) -> None:
    """Write rows into a table partitioned by ``by``: what the rows' own partitions held is replaced, others stay. A repeated insert of a revision changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], keep_known: list[str] = ()) -> DataFrame:
    """Insert-or-update by key; for ``keep_known`` columns a null does not overwrite a value."""
    o, n = existing.alias("o"), incoming.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full")
    there = F.col(f"n.{key[0]}").isNotNull()
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in key or c in keep_known else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*(pick(c).alias(c) for c in existing.columns))


def dedup_content(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """One row per content with its smallest key and its number of copies."""
    return rows.groupBy(digest).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"))


def alias_rows(rows: DataFrame, key: str, algorithms: list[str]) -> DataFrame:
    """(key, algo, digest): a digest table in long form."""
    return rows.unpivot(key, algorithms, "algo", "digest").where("digest IS NOT NULL")


def alias_tuples(aliases: DataFrame, key: str, algorithms: list[str]) -> DataFrame:
    """One row per key with a column per algorithm; incomplete tuples are dropped."""
    return aliases.groupBy(key).pivot("algo", algorithms).agg(F.min("digest")).dropna(subset=algorithms)


def unreferenced(candidates: DataFrame, key: str, references: list[DataFrame]) -> DataFrame:
    """Candidates that no reference table names (each has the key as its first column)."""
    named = reduce(DataFrame.union, (table.select(F.col(table.columns[0]).alias(key)) for table in references))
    return candidates.join(named.distinct(), key, "left_anti")


def orphan_marks(candidates: DataFrame, marks: DataFrame, key: str, now: int) -> DataFrame:
    """Marks of the present candidates; an old mark keeps the time it was first set, others lapse."""
    return candidates.select(key).distinct().join(marks.select(key, "marked_at"), key, "left").select(key, F.coalesce("marked_at", F.lit(now)).alias("marked_at"))


def storage_totals(contents: DataFrame) -> DataFrame:
    """One row for contents(size, resident): bytes on disk, bytes represented, and how many contents have no known size."""
    return contents.agg(F.sum(F.when(F.col("resident"), F.col("size"))).alias("on_disk"), F.sum("size").alias("represented"), F.count_if(F.col("size").isNull()).alias("sizeless"))


def kept_back(candidates: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Candidates that no operator has marked to keep."""
    return candidates.join(keep.select(F.col(keep.columns[0]).alias(key)).distinct(), key, "left_anti")


def delete_reviewed(listed: DataFrame, candidates: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Rows to delete of a reviewed list: those that are candidates still, and the parts(key, part) that no kept content uses.

    Returns (key, cause): "reviewed" or "cascade".
    """
    gone = listed.select(key).join(candidates.select(key), key, "left_semi").distinct()
    alive = parts.join(gone, key, "left_anti").select(F.col("part").alias(key)).distinct()
    cascade = parts.join(gone, key, "left_semi").select(F.col("part").alias(key)).distinct().join(alive, key, "left_anti").join(gone, key, "left_anti")
    return gone.withColumn("cause", F.lit("reviewed")).unionByName(cascade.withColumn("cause", F.lit("cascade")))


def review_list(marks: DataFrame, grace: int, now: int) -> DataFrame:
    return marks.where(F.col("marked_at") <= now - grace)


def sharing(recipes: DataFrame, percent: int) -> DataFrame:
    """Recipes whose inputs are shared enough to be worth a swap.

    recipes(recipe, blob, size): shared is the size of inputs that stand in two or more
    recipes; a recipe with an input of unknown size is left out.
    """
    uses = recipes.groupBy("blob").agg(F.count_distinct("recipe").alias("uses"))
    totals = recipes.join(uses, "blob").groupBy("recipe").agg(F.sum(F.when(F.col("uses") >= 2, F.col("size")).otherwise(0)).alias("shared"), F.sum("size").alias("total"), F.count_if(F.col("size").isNull()).alias("unknown"))
    return totals.where((F.col("unknown") == 0) & (F.col("total") > 0) & (F.col("shared") * 100 >= F.col("total") * percent)).select("recipe", "shared", "total")


def pack_sets(members: DataFrame, least: int = 4) -> DataFrame:
    """A piece belongs to the first set that holds it; sets left with fewer than ``least`` pieces are not packed.

    members(set, piece, size) -> (set, piece, offset).
    """
    owned = members.groupBy("piece").agg(F.min(F.struct("set", "size")).alias("o")).select(F.col("o.set").alias("set"), "piece", F.col("o.size").alias("size"))
    big = owned.groupBy("set").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("set")
    w = Window.partitionBy("set").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return owned.join(big, "set").select("set", "piece", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("offset"))


def scrub(stored: DataFrame, found: DataFrame, key: str = "hash", percent: int = 100, by: str = "digest") -> DataFrame:
    """Compare a stored table(key, digest) with a re-hash(key, digest): valid, corrupt or missing.

    ``percent`` below 100 takes a repeatable sample by the first byte of the hex column ``by``.
    """
    if percent < 100:
        stored = stored.where(hash_sample(F.col(by), percent))
    return stored.alias("s").join(found.alias("f"), key, "left").select(key, F.when(F.col("f.digest").isNull(), "missing").when(F.col("f.digest") == F.col("s.digest"), "valid").otherwise("corrupt").alias("result"))
