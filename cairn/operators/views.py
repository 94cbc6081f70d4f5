"""Views: a query, a selection and a layout, evaluated to an immutable manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators.byteops import fit_component_udf
from cairn.operators.layout import directory_children
from cairn.operators.selection import best_struct, settle_paths
from cairn.session import cut, written

#: Bytes of a name that stay free for the suffix of a collision.
SUFFIX_RESERVE = 11


@dataclass(frozen=True)
class Profile:
    """What the device that a view is for can hold."""

    fat: bool = False
    name_bytes: int | None = None
    max_size: int | None = None
    directory_limit: int | None = None


# Limits of file systems and devices.
PROFILES = {
    "plain": Profile(),
    "fat32": Profile(fat=True, name_bytes=255, max_size=(4 << 30) - 1, directory_limit=65_534),
    "everdrive": Profile(fat=True, name_bytes=255, max_size=(4 << 30) - 1, directory_limit=1_000),
    "mister": Profile(fat=True, name_bytes=255, directory_limit=10_000),
    "ezflash-omega": Profile(fat=True, name_bytes=99, max_size=(4 << 30) - 1, directory_limit=512),
}


@dataclass(frozen=True)
class ViewDef:
    """How candidates(entry, entry_name, name, hash, size, family, <score columns>) become paths."""

    name: str
    template: str = "{alpha_bucket}/{name}"
    one_per_family: bool = False
    score: tuple[str, ...] = ()
    profile: str | Profile = "plain"
    merge_mode: str | None = None

    def __post_init__(self):
        if isinstance(self.profile, str) and self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}")
        if "{name}" not in self.template and "{entry}" not in self.template:
            raise ValueError("a template needs {name} or {entry}")
        if self.one_per_family and not self.score:
            raise ValueError("a selection needs a score")
        if self.one_per_family and self.merge_mode:
            raise ValueError("sets of machines are not selected one by one")

    def limits(self) -> Profile:
        return PROFILES[self.profile] if isinstance(self.profile, str) else self.profile


def constrained(path: Column, limits: Profile) -> Column:
    """The path with every component in the profile's characters and length."""
    parts = F.split(path, "/")
    if limits.fat:
        parts = F.transform(parts, C.fat_component)
    joined = F.array_join(parts, "/")
    return fit_component_udf(limits.name_bytes - SUFFIX_RESERVE)(joined) if limits.name_bytes else joined


def bucketed(rows: DataFrame, limit: int) -> DataFrame:
    """(path, ...) rows where files in directories with over ``limit`` children have moved into a bucket by their first letter.

    A moved path that is taken gets a suffix of its hash; if that is taken too the file stays.
    """
    parent = F.expr("substring(path, 1, greatest(length(path) - length(substring_index(path, '/', -1)) - 1, 0))")
    full = directory_children(rows, "path").where(F.col("n_children") > limit).select(F.col("dir").alias("__dir"))
    placed = rows.withColumn("__dir", parent).join(full.withColumn("__full", F.lit(True)), "__dir", "left")
    leaf = F.substring_index("path", "/", -1)
    head = F.when(F.col("__dir") == "", "").otherwise(F.concat("__dir", F.lit("/")))
    moved = F.concat(head, C.alpha_bucket(leaf), F.lit("/"), leaf)
    placed = placed.withColumn("__wanted", F.when(F.col("__full"), moved).otherwise(F.col("path"))).withColumn("__other", C.with_suffix(F.col("__wanted"), hash_suffix()))
    settled = settle_paths(placed, "__wanted", "__other", [F.coalesce(F.col("__full"), F.lit(False)).asc(), F.asc("__order")], "path")
    return settled.drop("path", "__dir", "__full", "__wanted", "__other").withColumnRenamed("final_path", "path")


def hash_suffix() -> Column:
    return F.concat(F.lit(" ("), F.substring("hash", 1, 8), F.lit(")"))


def evaluate(view: ViewDef, candidates: DataFrame) -> DataFrame:
    """(path, entry, hash, size), each path once and canonical.

    Select one of each family if asked, leave out files that the profile cannot hold, expand the template, repair paths
    that are not canonical, apply the profile's characters and lengths, give paths that are taken a suffix of the hash
    before their extension (a second collision drops the row), and move files of overfull directories into buckets. Rows claim
    their paths in the order of entry, then name.
    """
    rows, limits = candidates, view.limits()
    if "entry_name" not in rows.columns:
        rows = rows.withColumn("entry_name", F.col("entry").cast("string"))
    if view.one_per_family:
        rows = best_struct(rows, ["family"], list(view.score), ["entry", "entry_name", "name", "hash", "size"])
    if limits.max_size is not None:
        rows = rows.where(F.col("size") <= limits.max_size)
    full = C.expand_template(view.template, entry=C.safe_component(F.col("entry_name")), name=C.safe_name(F.col("name")), alpha_bucket=C.alpha_bucket(F.col("name")))
    path = F.when(C.canonical_path(full), full).otherwise(C.safe_name(full))
    rows = rows.select("entry", "hash", "size", constrained(path, limits).alias("path"), F.struct("entry", "name").alias("__order"))
    rows = rows.withColumn("__other", C.with_suffix(F.col("path"), hash_suffix()))
    rows = settle_paths(rows, "path", "__other", [F.asc("__order")]).drop("path", "__other").withColumnRenamed("final_path", "path")
    if limits.directory_limit is not None:
        rows = bucketed(cut(rows), limits.directory_limit)
    return rows.select("path", "entry", "hash", "size")


def snapshot(manifest: DataFrame) -> DataFrame:
    """Write the manifest sorted by path; a repeated path is an error."""
    twice = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("a view has the same path twice")
    return written(manifest.repartitionByRange("path").sortWithinPartitions("path"))
