"""Tables a job writes between two of its stages.

A stage that several later stages read is written once, to the shared folder the
cluster names in ``spark.checkpoint.dir``: nothing is computed twice, the lineage
ends there, and a lost executor costs only its own tasks. ``staged_in`` names another
folder for a run, and ``remove_staged`` deletes what was staged below one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "pagesift.staging.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_root(spark: SparkSession) -> str:
    """The folder a caller chose, the session's, or on one machine a temporary one."""
    sc = spark.sparkContext
    root = spark.conf.get(_FOLDER, "") or spark.conf.get("spark.checkpoint.dir", "")
    root = root or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="pagesift-")
        spark.conf.set(_FOLDER, root)
    return root.rstrip("/")


@contextmanager
def staged_in(spark: SparkSession, folder: str) -> Iterator[str]:
    """Tables staged inside the block go below ``folder``, which all executors must share."""
    before = spark.conf.get(_FOLDER, "")
    spark.conf.set(_FOLDER, folder)
    try:
        yield folder
    finally:
        if before:
            spark.conf.set(_FOLDER, before)
        else:
            spark.conf.unset(_FOLDER)


def remove_staged(spark: SparkSession, folder: str | None = None) -> bool:
    """Deletes the tables staged below ``folder`` (default: the session's); True if any were.

    Results that still read them cannot be computed afterwards, so write them first.
    """
    jvm, path = spark._jvm, f"{(folder or staging_root(spark)).rstrip('/')}/pagesift"
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/pagesift/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside the block go as soon as it is written.

    Without it they stay until the driver happens to collect its garbage, and a job of many
    stages fills the executors' disks with files that nothing reads again.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet, in half the room that the default codec takes, and return the table read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_folder = path
    return out


def release(*staged: DataFrame) -> None:
    """Deletes tables that ``stage`` returned, once nothing is left to be computed from them."""
    for df in staged:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_folder)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
