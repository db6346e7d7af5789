"""Every registered query runs, has a stable schema, and agrees with its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from pixelquarry.plans import catalog
from pixelquarry.sources.scenes import pixel_pair, read

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return None if x != x else round(float(x), 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rows = sorted(repr([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    if name not in catalog.oracle_sql():
        assert rows
        return
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def formatted(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_push_down_and_prune(spark):
    """A scan reads the columns that are used, filters reach it, and nothing is paired with all."""
    plan = formatted(catalog.queries()["valid_mask"](spark, SF))
    assert "l_comment" not in plan and "CartesianProduct" not in plan
    late = formatted(read(spark, SF, "lineitem").where("l_shipdate >= TIMESTAMP '1998-05-24'").select("l_orderkey"))
    assert "GreaterThanOrEqual(l_shipdate" in late and "l_tax" not in late
    pair = formatted(pixel_pair(spark, SF))
    assert pair.count("Location: InMemoryFileIndex") == 2  # the lines once for both dates
    overlap = formatted(catalog.queries()["footprint_overlap"](spark, SF))
    assert "CartesianProduct" not in overlap and "BroadcastNestedLoopJoin" not in overlap


def test_parsing_takes_no_shuffle(spark):
    for name in ("parse_grounding", "vqa_intent", "read_change_question"):
        assert "Exchange" not in formatted(catalog.queries()[name](spark, SF))
