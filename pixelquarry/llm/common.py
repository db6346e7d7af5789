"""What the operators of this subpackage share: staged tables and word patterns."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks (fixed by the queries' contract).
WORD = r"[^\x20\x09-\x0D]+"
#: Where each staged table lies, for as long as its first DataFrame lives.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and everything runs on
    one machine, as in tests, a folder of this run is set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage (a lost executor costs a reread, not a recomputation) and gives every
    reader of the table the same rows.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[written] = path
    return written


def discard(written: DataFrame) -> None:
    """Delete a table that ``staged`` wrote and that nothing reads any more."""
    context = written.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_paths.pop(written))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with each row in one struct column, ``row``, beside the ``columns`` given.

    So no name that an operator needs can meet one of the table's; ``row.*`` opens the box.
    """
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
