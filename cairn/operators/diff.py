"""Differences: catalog revisions, id sets, path manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric_difference(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = local.select(key).distinct(), remote.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("local")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("remote")))


def is_dirty(before: DataFrame, after: DataFrame) -> bool:
    """Do two tables differ as bags of rows?"""
    return not (before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty())


def revision_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Match entries(id, stable_key, name, fp) of two revisions in three passes and classify them.

    Passes, each over what is still unmatched: stable key, name, then fingerprint
    where it is unique on both sides. Among equal old keys the largest id is the
    partner (the last one wins). Matched with another fingerprint: rehashed, even if
    renamed too; same fingerprint and another name: renamed; the rest is added or
    removed; unchanged pairs are not listed.
    """
    pairs = None
    rest_old, rest_new = old, new
    for key in ("stable_key", "name", "fp"):
        o, n = rest_old.where(F.col(key).isNotNull()), rest_new.where(F.col(key).isNotNull())
        if key == "fp":
            single = lambda df: df.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1").select("fp", "id")
            match = single(o).withColumnRenamed("id", "old_id").join(single(n).withColumnRenamed("id", "new_id"), "fp")
        else:
            last = o.groupBy(key).agg(F.max("id").alias("old_id"))
            match = n.select(key, F.col("id").alias("new_id")).join(last, key)
        match = match.select("old_id", "new_id")
        pairs = match if pairs is None else pairs.union(match)
        rest_old = rest_old.join(match.select(F.col("old_id").alias("id")), "id", "left_anti")
        rest_new = rest_new.join(match.select(F.col("new_id").alias("id")), "id", "left_anti")
    o = old.select(F.col("id").alias("old_id"), F.col("name").alias("old_name"), F.col("fp").alias("old_fp"))
    n = new.select(F.col("id").alias("new_id"), F.col("name").alias("new_name"), F.col("fp").alias("new_fp"))
    matched = pairs.join(o, "old_id").join(n, "new_id")
    kind = F.when(~F.col("old_fp").eqNullSafe(F.col("new_fp")), "rehashed").when(F.col("old_name") != F.col("new_name"), "renamed")
    changed = matched.select(kind.alias("change"), "old_id", "new_id").where("change IS NOT NULL")
    none = F.lit(None)
    removed = rest_old.select(F.lit("removed").alias("change"), F.col("id").alias("old_id"), none.cast("long").alias("new_id"))
    added = rest_new.select(F.lit("added").alias("change"), none.cast("long").alias("old_id"), F.col("id").alias("new_id"))
    return changed.union(removed).union(added)


def sync_plan(manifest: DataFrame, inventory: DataFrame, delete: bool = True) -> DataFrame:
    """(path, action) to make an inventory(path, size) equal a manifest(path, size): copy, replace, delete or keep."""
    m, i = manifest.select("path", F.col("size").alias("want")), inventory.select("path", F.col("size").alias("have"))
    action = F.when(F.col("have").isNull(), "copy").when(F.col("want").isNull(), "delete" if delete else "ignore").when(F.col("want") != F.col("have"), "replace").otherwise("keep")
    return m.join(i, "path", "full").select("path", action.alias("action"))


def content_fingerprint(claims: DataFrame, entry: str, fields: list[str]) -> DataFrame:
    """Order-insensitive digest of an entry's claims; nulls are tagged, so a null differs from an empty value."""
    line = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("v"), F.col(f).cast("string")), F.lit("n")) for f in fields))
    return claims.groupBy(entry).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fp"))
