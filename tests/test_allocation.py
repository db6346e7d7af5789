"""Identifiers of records: several writers at once, years, gaps and what is refused."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pixelquarry.sources.allocation import Claims
from pixelquarry.sources.sinks import RecordStore

DDL = "request_id long, created_at timestamp"


def records(spark, n, start="2025-12-31 23:59:50", hot=False):
    at = F.lit(start).cast("timestamp") if hot else F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(start).cast("timestamp"))
    return spark.range(n).select(F.col("id").alias("request_id"), at.alias("created_at"))


def test_writers_at_once_never_share_a_number(spark, tmp_path):
    def write(k):
        claims = Claims(spark, str(tmp_path / "with space"))
        return [(claims.take(2026, n), n) for n in range(1, 16)]

    with ThreadPoolExecutor(6) as pool:
        runs = sorted(r for part in pool.map(write, range(6)) for r in part)
    assert len(runs) == 90 and runs[0][0] == 1
    assert all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:]))  # no overlap and, as none failed, no gap
    with pytest.raises(ValueError):
        Claims(spark, str(tmp_path / "x")).take(2026, 0)


def test_a_table_is_numbered_within_its_years(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "a"))
    rows = sorted((r.request_id, r.id) for r in store.add(records(spark, 25)).collect())
    assert rows == [(k, f"SAT-2025-{k + 1:06d}" if k < 10 else f"SAT-2026-{k - 9:06d}") for k in range(25)]
    store.add(records(spark, 3, "2026-05-01", hot=True))  # one time for all: by key
    assert {r.id for r in store.all().where("created_at >= '2026-05-01'").collect()} == {f"SAT-2026-{k:06d}" for k in (16, 17, 18)}
    assert store.get("SAT-2026-000016").first().request_id == 0


def test_two_tables_at_once(spark, tmp_path):
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: RecordStore(spark, str(tmp_path / "b")).add(records(spark, 40, hot=True)), range(2)))
    found = RecordStore(spark, str(tmp_path / "b")).all()
    assert found.count() == found.select("id").distinct().count() == 80


def test_numbers_follow_what_is_stored_without_a_claim(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "c"))
    store.append(spark.createDataFrame([("SAT-2026-000041", 1), ("SAT-2025-000007", 2), ("other", 3)], "id string, request_id long"))
    assert [r.id for r in store.add(records(spark, 2, "2026-01-01")).orderBy("id").collect()] == ["SAT-2026-000042", "SAT-2026-000043"]
    claims = store.claims
    assert claims.newest(2026) == (0, 44) and claims.newest(2025) == (-1, 1)


def test_what_is_refused(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "d"))
    assert store.add(spark.createDataFrame([], DDL)).count() == 0
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([(1, None)], DDL))
    with pytest.raises(ValueError):
        store.add(records(spark, 1).withColumn("id", F.lit("x")))
    assert store.all().count() == 0
