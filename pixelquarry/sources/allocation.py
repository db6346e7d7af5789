"""Record identifiers, SAT-<year>-<six digits>, for whole tables and several writers at once.

A writer claims a run of numbers of a year by putting down a small file under the next free name; the file holds
the first number after the run. Where another one was faster, it reads that file and tries the next name. So two
writers never hold the same number, and one claim serves a batch of any size. A writer that fails after its
claim leaves a gap, never a number that is given twice.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelquarry.operators.staging import discard, staged_at

PREFIX = "SAT"


class Claims:
    """Claims under ``path``, a folder a year, on a file system that the writers share.

    It must refuse, as HDFS does, to rename a file to a name that is taken; on a local disk a hard link does.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = root.getFileSystem(conf)
        self.path = self._fs.makeQualified(root).toString().rstrip("/")

    def _at(self, *names: object):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, names)]))

    def newest(self, year: int) -> tuple[int, int]:
        """The newest claim of a year and the first number after it: (-1, 1) without any."""
        folder = self._at(year)
        if not self._fs.exists(folder):
            return -1, 1
        names = [int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()]
        return (max(names), self._after(year, max(names))) if names else (-1, 1)

    def _after(self, year: int, claim: int) -> int:
        stream = self._fs.open(self._at(year, f"{claim:012d}"))
        try:
            return int(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, year: int, claim: int, after: int) -> bool:
        """Whether this writer was the first to put down that claim: it appears whole or not at all."""
        draft, target = self._at(year, f"draft-{uuid.uuid4().hex}"), self._at(year, f"{claim:012d}")
        stream = self._fs.create(draft, False)
        stream.write(str(after).encode())
        stream.close()
        if self._fs.getUri().getScheme() != "file":
            won = self._fs.rename(draft, target)
        else:
            try:
                os.link(*[unquote(urlparse(p.toString()).path) for p in (draft, target)])
                won = True
            except FileExistsError:
                won = False
        self._fs.delete(draft, False)
        return bool(won)

    def take(self, year: int, count: int, above: int = 0) -> int:
        """The first of ``count`` consecutive numbers over ``above`` that are this writer's from now on."""
        if count < 1:
            raise ValueError("a claim is of one number at least")
        claim, free = self.newest(year)
        while not self._put(year, claim + 1, max(free, above + 1) + count):
            claim += 1
            free = self._after(year, claim)
        return max(free, above + 1)


def record_id(year: Column, number: Column) -> Column:
    return F.format_string(f"{PREFIX}-%d-%06d", year, number)


def taken(stored: DataFrame, years: list[int]) -> dict[int, int]:
    """The largest number of each of ``years`` among the ids of ``stored``; years without one are absent."""
    part = lambda k: F.regexp_extract("id", rf"^{PREFIX}-(\d{{4,}})-(\d{{6,}})$", k)
    numbers = stored.select(part(1).alias("year"), part(2).cast("long").alias("n")).where(F.col("year").isin([str(y) for y in years]))
    return {int(r["year"]): r["n"] for r in numbers.groupBy("year").agg(F.max("n").alias("n")).collect()}


def with_ids(records: DataFrame, created: str, key: str, claims: Claims, stored: DataFrame | None = None) -> DataFrame:
    """``records`` with id: numbered within the year of ``created`` by time, then by ``key``.

    Numbers follow what is claimed and, for a year's first claim, what ``stored`` holds. A record whose time is
    null, or that has an id, is refused; no records claim nothing. Records are cut into ranges of
    (time, key), so that no time or year is one task's; a range counts its records by year, and only a number a
    year comes to the driver.
    """
    if "id" in records.columns:
        raise ValueError("these records have an id")
    spark = records.sparkSession
    ranged = records.repartitionByRange(created, key).withColumns({"_year": F.year(created), "_part": F.spark_partition_id()})
    rows, path = staged_at(ranged)
    counts = rows.groupBy("_year", "_part").agg(F.count("*").alias("_n"))
    totals = {r["_year"]: r["n"] for r in counts.groupBy("_year").agg(F.sum("_n").alias("n")).collect()}
    if None in totals:
        discard(spark, path)
        raise ValueError("a record has no time")
    fresh = [y for y in totals if claims.newest(y)[0] < 0]
    above = taken(stored, fresh) if stored is not None and fresh else {}
    first = [(y, claims.take(y, n, above.get(y, 0))) for y, n in sorted(totals.items())]
    earlier = Window.partitionBy("_year").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(spark.createDataFrame(first, "_year int, _first long"), "_year")
    starts = starts.select("_year", "_part", (F.col("_first") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_year", "_part").orderBy(created, key)) - 1
    numbered = rows.withColumn("_place", place).join(starts, ["_year", "_part"])
    return numbered.withColumn("id", record_id(F.col("_year"), F.col("_start") + F.col("_place"))).select("id", *records.columns)
