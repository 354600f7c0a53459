"""Session settings shared by tests, benchmarks and scripts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, driver_memory: str = "12g") -> SparkSession:
    """A local session; on a cluster, use the session the cluster gives instead."""
    return (
        SparkSession.builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("cotejo")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; local-cluster starts executors of its own."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only for a local session without it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not one_process(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='cotejo-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder with all it holds."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a checkpoint in the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, each: int = 3) -> DataFrame:
    """A table's rows in so many partitions a core at least; for work on rows that is heavier than to shuffle them.

    Files are cut by bytes, so a small file of many short rows would be one task's.
    """
    least = df.sparkSession.sparkContext.defaultParallelism * each
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a context, for those that can't import it themselves.

    The driver serves the file, so no shared folder is needed. Where the package is not a folder,
    it was installed or sent already.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_cotejo_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="cotejo-")) / "cotejo_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cotejo_shipped = True
