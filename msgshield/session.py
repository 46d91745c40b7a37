"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The temporary folder of a local session without the setting.
_LOCAL_ROOTS: set[str] = set()

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the submitting job brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("msgshield")
    settings = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Everything of one application lies in one subfolder, which can be deleted when the application is done. Only a
    local session may go without the setting; it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = next(iter(_LOCAL_ROOTS), None) or tempfile.mkdtemp(prefix="msgshield-")
        _LOCAL_ROOTS.add(root)
    return os.path.join(root, f"msgshield-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")


def remove_intermediate(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Call it when no frame that reads them is needed any more."""
    roots = {os.path.dirname(shared_dir(spark, "x"))} | _LOCAL_ROOTS
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without overriding a folder that is already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from the loss of executors.

    For inputs that an operator reads several times.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
