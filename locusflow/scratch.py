"""The folder that all executors share: for checkpoints, and for files that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own, else a temporary one in local mode.

    ``spark.checkpoint.dir`` is read from the session. Only where neither it nor the context
    has a folder is one made, and that only for a local master, where every task shares a disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if not current:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if not current:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="locusflow-checkpoint-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def through_files(spark: SparkSession, run: Callable[[str], DataFrame]) -> DataFrame:
    """What ``run`` reads from files that it writes to a folder of its own, which is then deleted."""
    place = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    found = checkpointed(run(place))
    remove(spark, place)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
