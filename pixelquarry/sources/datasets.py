"""Benchmark datasets as rows of one schema; a missing file is an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_DDL = "sample_id string, image_path string, modality string, question string, answer string, second_image_path string"


def _read(spark: SparkSession, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], SAMPLE_DDL)
        raise


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines whose first comma-separated field names an image."""
    first = F.trim(F.split("value", ",")[0])
    return _read(spark, lambda: spark.read.text(path).where(F.trim("value") != "").select(
        first.alias("sample_id"), first.alias("image_path"), F.lit("optical").alias("modality"), *[F.lit(None).cast("string").alias(n) for n in ("question", "answer", "second_image_path")]
    ))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of samples in our schema's names."""
    return _read(spark, lambda: spark.read.schema(SAMPLE_DDL).json(path, multiLine=True))


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """path and label of images kept in one folder for each class."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.withColumn("label", F.element_at(F.split("path", "/"), -2))
