"""Paths and directories of rendered views, and merge modes of machine sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.graph import chain_top, closure


def directory_children(paths: DataFrame, path: str) -> DataFrame:
    """(dir, n_children): distinct children of every ancestor directory; the root is the empty string."""
    parts = F.split(F.col(path), "/")
    levels = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", F.lit(1), i - 1), "/").alias("dir"), F.get("p", i - 1).alias("child")))
    rows = paths.select(parts.alias("p")).select(F.explode(levels).alias("x")).select("x.dir", "x.child").distinct()
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n_children"))


def listing(paths: DataFrame, path: str, prefix: str) -> DataFrame:
    """(child, is_dir, n_files) directly below a directory prefix that ends in a slash (or is empty)."""
    below = paths.where(F.col(path).startswith(prefix)).select(F.substring(F.col(path), F.lit(len(prefix) + 1), F.length(path)).alias("rest"))
    child = F.substring_index("rest", "/", 1)
    return below.groupBy(child.alias("child")).agg((F.max(F.instr("rest", "/")) > 0).alias("is_dir"), F.count(F.lit(1)).alias("n_files"))


def bucket_overfull(rows: DataFrame, directory: str, name: str, limit: int, bucket: Column) -> DataFrame:
    """Directories with over ``limit`` entries get their entries moved into bucket sub-directories."""
    sizes = rows.groupBy(directory).agg(F.count(F.lit(1)).alias("__n"))
    joined = rows.join(sizes, directory)
    head = F.when(F.col(directory) == "", F.lit("")).otherwise(F.concat(F.col(directory), F.lit("/")))
    return joined.withColumn("final_path", F.concat(head, F.when(F.col("__n") > limit, F.concat(bucket, F.lit("/"))).otherwise(""), F.col(name))).drop("__n")


def render_sets(machines: DataFrame, claims: DataFrame, devices: DataFrame, mode: str) -> DataFrame:
    """(set, file, claim) of a merge mode, each (set, file, hash) once.

    machines(machine, parent, is_device, is_bios), claims(claim, machine, file, hash, merge_name), devices(machine, device).
    non-merged: machines that are no devices, with their own claims and those of the transitive device closure;
    split: the claims that do not name a parent's file; merged: the same claims, where clones fold into the top of
    their clone chain (over 32 links are an error) and devices and BIOS sets stay alone.
    """
    if mode == "non-merged":
        roots = machines.where("NOT is_device").select(F.col("machine").alias("root"))
        reach = closure(devices, roots, "machine", "device")
        rows = reach.join(claims, reach.node == claims.machine).select(F.col("root").alias("set"), "file", "hash", "claim")
    elif mode == "split":
        rows = claims.where("merge_name IS NULL").join(machines.select("machine"), "machine").select(F.col("machine").alias("set"), "file", "hash", "claim")
    elif mode == "merged":
        tops = chain_top(machines.select(F.col("machine").alias("node"), "parent"))
        flags = machines.select("machine", "is_device", "is_bios")
        own = claims.where("merge_name IS NULL").join(flags, "machine").join(tops, F.col("machine") == F.col("node"))
        alone = F.col("is_device") | F.col("is_bios")
        rows = own.select(F.when(alone, F.col("machine")).otherwise(F.col("top")).alias("set"), "file", "hash", "claim")
    else:
        raise ValueError(f"unknown merge mode {mode!r}")
    return rows.groupBy("set", "file", "hash").agg(F.min("claim").alias("claim")).select("set", "file", "claim")


def file_name(name: Column, kind: Column) -> Column:
    """Disks are stored with .chd, unless their name has it."""
    return F.when((kind == "disk") & ~F.lower(name).endswith(".chd"), F.concat(name, F.lit(".chd"))).otherwise(name)


def dangling_devices(machines: DataFrame, devices: DataFrame) -> DataFrame:
    """(set, n): references to devices that do not exist, per rendered set and by occurrence in its device closure."""
    real = machines.select("machine")
    known = devices.join(real.withColumnRenamed("machine", "device"), "device", "left_semi")
    reach = closure(known, machines.where("NOT is_device").select(F.col("machine").alias("root")), "machine", "device")
    lost = devices.join(real.withColumnRenamed("machine", "device"), "device", "left_anti")
    return reach.join(lost, reach.node == lost.machine).groupBy(F.col("root").alias("set")).agg(F.count(F.lit(1)).alias("n"))


def cluster_layout(files: DataFrame, image: str, order: list[str], size: str, cluster: int, first: int = 2) -> DataFrame:
    """First cluster and cluster count of each file of an image: a prefix sum of rounded sizes."""
    count = F.ceil(F.col(size) / cluster).cast("long")
    w = Window.partitionBy(image).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("clusters", count).withColumn("first_cluster", F.when(F.col("clusters") > 0, F.coalesce(F.sum("clusters").over(w), F.lit(0)) + first).otherwise(F.lit(0)))
