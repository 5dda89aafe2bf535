"""Spark session settings the operators count on."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed join partitions, merges small shuffle
# partitions and switches to a broadcast join once a side is seen to be small.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoints go once no frame refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def spark_session(app_name: str, master: str | None = None, **extra: str) -> SparkSession:
    """Get or create a session; sizes and master stay with ``spark-submit``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoint_folder(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The shared folder comes from ``spark.checkpoint.dir``. Only a local master,
    where one machine is all there is, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tastewright-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def shared_path(spark: SparkSession) -> str:
    """A new path in the checkpoint folder; what is written there goes when Python ends, if not before."""
    use_checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid4()}"
    atexit.register(_drop_at_exit, spark, path)
    return path


def written_table(rows: DataFrame, **options) -> tuple[DataFrame, str]:
    """``rows`` as a parquet table in the checkpoint folder, and its path.

    Like a checkpoint, but compressed, and read back by column. ``options`` go
    to the writer.
    """
    path = shared_path(rows.sparkSession)
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.parquet(path), path


def drop_written_table(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let shuffle files and checkpoints go that no frame needs any more.

    Spark removes them once the driver's JVM has collected the frames, which a
    driver with memory to spare may put off until the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    # A session may be stopped and its JVM gone by then; the folder's owner clears what is left.
    with contextlib.suppress(Exception):
        drop_written_table(spark, path)
