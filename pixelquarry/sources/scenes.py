"""Scenes over the given tables: one pixel for each order, 125 by 48 of them a scene.

So scenes are many and each is bounded, as the reader's edge limit bounds those that come from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 125, 48
#: Edge of a field in pixels.
FIELD = 8
#: The ship date that parts the two dates of a pair.
PAIR_CUT = "1998-05-24"
BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bands(lines: DataFrame, by: list[str], in_order: bool = False) -> DataFrame:
    """Six bands for each order, from aggregates of its lines.

    Sums of doubles hang on the order of additions, in their last bit, and a shuffle has none. With ``in_order``
    the lines, as they come from files, are added up by file and place there.
    """
    of = lambda f, n: f(n)
    if in_order:
        placed = Window.partitionBy("l_orderkey", *by).orderBy("_metadata.file_path", "_metadata.row_index")
        of = lambda f, n: f(n).over(placed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bands = [
        (of(F.avg, "l_tax") + 0.02).alias("blue"),
        (of(F.avg, "l_discount") + 0.02).alias("green"),
        (of(F.avg, "l_tax") * 0.5 + 0.03).alias("red"),
        (of(F.avg, "l_quantity") / 100.0).alias("nir"),
        (of(F.avg, "l_extendedprice") / 400000.0).alias("swir1"),
        (of(F.max, "l_discount") + 0.01).alias("swir2"),
    ]
    key = F.col("l_orderkey").alias("o_orderkey")
    if in_order:
        return lines.select(key, *by, *bands, F.row_number().over(placed).alias("_n")).where("_n = 1").drop("_n")
    return lines.groupBy(key, *by).agg(*bands)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, scene_id, r, c and vv (linear power) of each order."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.floor(key / F.lit(float(WIDTH * HEIGHT))).alias("scene_id"),
        F.floor(key % (WIDTH * HEIGHT) / F.lit(float(WIDTH))).cast("int").alias("r"),
        (key % WIDTH).cast("int").alias("c"),
        (F.col("o_totalprice") / 1000000.0).alias("vv"),
    )


def _in_fields(px: DataFrame, by: list[str]) -> DataFrame:
    """``px`` with the bands of each field's brightest pixel in all of its pixels."""
    part = [F.floor(F.col(x) / F.lit(float(FIELD))) for x in ("r", "c")]
    field = Window.partitionBy(*by, *part).orderBy(F.col("vv").desc(), "r", "c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return px.withColumns({b: F.first(b).over(field) for b in BANDS})


def pixel_grid(spark: SparkSession, sf_dir: str, fields: bool = False, in_order: bool = False) -> DataFrame:
    """scene_id, r, c, the six bands and vv; an order without lines is nodata.

    Neighbouring orders have nothing in common; with ``fields`` the scene is made of squares of
    ``FIELD`` pixels, each with the bands of its brightest pixel, so that it has patches. What cuts values off
    takes the lines ``in_order``: where they lie on a cut the last bit of a sum decides.
    """
    bands = _bands(read(spark, sf_dir, "lineitem"), [], in_order)
    px = _grid(spark, sf_dir).join(bands, "o_orderkey", "left").select("scene_id", "r", "c", *BANDS, "vv")
    return _in_fields(px, ["scene_id"]) if fields else px


def pixel_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, date (``before`` and ``after`` the cut), r, c, the six bands and vv, in fields.

    The lines are read once for both dates; every pixel has a row of each date.
    """
    early = F.to_date("l_shipdate") < F.lit(PAIR_CUT).cast("date")
    dated = read(spark, sf_dir, "lineitem").withColumn("date", F.when(early, "before").otherwise("after"))
    grid = _grid(spark, sf_dir).withColumn("date", F.explode(F.array(F.lit("before"), F.lit("after"))))
    px = grid.join(_bands(dated, ["date"]), ["o_orderkey", "date"], "left").select("scene_id", "date", "r", "c", *BANDS, "vv")
    return _in_fields(px, ["scene_id", "date"])


def grid_sql(where: str = "TRUE") -> str:
    """The same grid as SQL."""
    return f"""
SELECT o_orderkey // {WIDTH * HEIGHT} AS scene_id, (o_orderkey % {WIDTH * HEIGHT} // {WIDTH})::INT AS r, (o_orderkey % {WIDTH})::INT AS c,
       blue, green, red, nir, swir1, swir2, o_totalprice / 1000000.0 AS vv
FROM orders LEFT JOIN (
  SELECT l_orderkey, avg(l_tax) + 0.02 AS blue, avg(l_discount) + 0.02 AS green, avg(l_tax) * 0.5 + 0.03 AS red,
         avg(l_quantity) / 100.0 AS nir, avg(l_extendedprice) / 400000.0 AS swir1, max(l_discount) + 0.01 AS swir2
  FROM lineitem WHERE {where} GROUP BY l_orderkey) b ON o_orderkey = l_orderkey"""


def fields_sql(where: str = "TRUE") -> str:
    """The same grid in fields, as SQL."""
    field = f"(PARTITION BY scene_id, r // {FIELD}, c // {FIELD} ORDER BY vv DESC, r, c)"
    return f"SELECT scene_id, r, c, {', '.join(f'first_value({b}) OVER {field} AS {b}' for b in BANDS)}, vv FROM ({grid_sql(where)})"


PAIR_SQL = tuple(fields_sql(f"CAST(l_shipdate AS DATE) {op} DATE '{PAIR_CUT}'") for op in ("<", ">="))
