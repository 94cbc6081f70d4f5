"""Session, table and scratch-space helpers shared by every module."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(name: str = "cairn", cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless the paths they inherit reach it already."""
    root, context = Path(__file__).resolve().parents[1], spark.sparkContext
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if getattr(context, "_cairn_shipped", False) or any(p and Path(p).resolve() == root for p in paths):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='cairn-')}/cairn", "zip", root, "cairn")
    context.addPyFile(archive)
    context._cairn_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where the session names none and its master is local (tests, a laptop) is a temporary folder
    made and set, since driver and executors then share one machine; on a cluster it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="cairn-checkpoint-")
    context.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Smaller than a checkpoint for wide rows (columnar, compressed). The table is
    removed when the driver's interpreter ends, or by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cairn-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """written(df) and its number of rows, which the write itself observes."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, int(seen.get["n"])


def release(*tables: DataFrame | None) -> None:
    """Remove tables that written() made and no plan reads any more: a loop's earlier rounds."""
    for table in tables:
        if path := getattr(table, "_cairn_path", None):
            _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in a loop by a table in the shared folder (survives lost executors).

    A checkpoint would also carry the old plan's constraints into the next round,
    where renamed join keys multiply them until the driver's memory is full.
    """
    return written(df)
