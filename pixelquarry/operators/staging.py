"""Tables between stages of an analysis."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` is not."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder: ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine a new one is set.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not on_one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def staged_at(df: DataFrame, folders: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, with a folder for each value of ``folders``, and its path, for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.

    An analysis that reads its pixels several times (bounds, bins, moments, map) reads them from
    here and not through the whole plan again, and a lost executor costs a reread.
    """
    return staged_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``staged_at`` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
