"""Scratch tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts the lineage and survives the loss of an executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it, the shuffle files of a write go when the write has ended: nothing reads them again.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Schemes of folders on one machine's disk.
LOCAL_SCHEMES = ("", "file")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a session in one process gets a temporary folder, and a cluster a folder in its
    warehouse if that has a shared scheme; else this is an error, as executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="relicframe-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if warehouse.partition(":")[0] in LOCAL_SCHEMES or ":" not in warehouse:
                raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} is on one machine")
            root = warehouse.rstrip("/") + "/relicframe-scratch"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/relicframe/{label}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    atexit.register(clean)
    return path


def write_once(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, then read from there."""
    path = scratch_path(df.sparkSession, label)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
