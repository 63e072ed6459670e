"""Session helpers: the package on the workers, work on all cores."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Bytes of an Arrow batch, about; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, unless the session has a bound of its own. The value is the same for all
    operators and changes no result; a Python worker holds some such batches, however large its task is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":  # Spark's default
        spark.conf.set(key, str(BATCH_BYTES))


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once a session, unless their Python path has it already:
    workers inherit PYTHONPATH, and the working folder in local mode."""
    context = spark.sparkContext
    on_path = {Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *([""] if context.master.startswith("local[") else [])]}
    if ROOT in on_path or getattr(context, "_threatloom_sent", False):
        return spark
    folder = Path(tempfile.mkdtemp(prefix="threatloom-package-"))
    shutil.copytree(ROOT / "threatloom", folder / "tree/threatloom", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / "threatloom"), "zip", folder / "tree"))
    context._threatloom_sent = True
    return spark


def spread(df: DataFrame, table: str) -> DataFrame:
    """``df``, which reads the Parquet ``table``, dealt round robin over the cores if the files make fewer than two splits a
    core. Scans of whole texts and pages are bound by the processor, and however a small file is split, one task reads
    each row group. Larger inputs stay where they are: nothing is shuffled. The size is that of the files: no job runs.
    Python functions over such rows get them in small batches."""
    spark = df.sparkSession
    small_batches(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < 2 * cores * split else df
