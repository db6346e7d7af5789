"""Scenes whose values hang on the order in which an order's lines are added up."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pixelquarry.plans import catalog


def written(folder, tax, discount, quantity):
    """Orders of four lines, of which each of two files has two; the lines' values have a row an order."""
    n = len(tax)
    keys = np.arange(n)
    pq.write_table(pa.table({"o_orderkey": keys, "o_totalprice": keys * 1.0}), folder / "orders.parquet")
    (folder / "lineitem.parquet").mkdir()
    for k in (0, 1):
        of = slice(2 * k, 2 * k + 2)
        columns = {"l_tax": tax[:, of], "l_discount": discount[:, of], "l_quantity": quantity[:, of], "l_extendedprice": quantity[:, of] * 100}
        table = {"l_orderkey": np.repeat(keys, 2), **{c: v.ravel() for c, v in columns.items()}}
        pq.write_table(pa.table(table), folder / "lineitem.parquet" / f"part-{k}.parquet")
    return str(folder)


def levels(tax, quantity, order):
    """The heat map's levels, with sums in an order of additions."""
    red, nir = order(tax) / 4 * 0.5 + 0.03, order(quantity) / 4 / 100.0
    return np.floor(np.clip(((nir - red) / (nir + red) + 1) / 2, 0, 1) * 255)


@pytest.fixture
def sf(tmp_path):
    """Lines in hundredths: orders whose level hangs on the order of additions, and others."""
    random = np.random.default_rng(7)
    tax, discount = random.integers(0, 9, (200_000, 4)) / 100, random.integers(0, 11, (200_000, 4)) / 100
    quantity = random.integers(1, 51, (200_000, 4)) * 1.0
    a = levels(tax, quantity, lambda x: ((x[:, 0] + x[:, 1]) + x[:, 2]) + x[:, 3])
    b = levels(tax, quantity, lambda x: (x[:, 0] + x[:, 1]) + (x[:, 2] + x[:, 3]))
    some = np.r_[np.flatnonzero(a != b), np.arange(5000)]
    assert (a != b).sum() > 10
    return written(tmp_path, tax[some], discount[some], quantity[some])


def agrees(spark, sf, name):
    """With the SQL on one thread, which takes the lines as they come."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'; CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, sf).select(*want.columns).collect()
    return sorted(map(tuple, got)) == sorted(want.fetchall())


def test_index_heatmap_adds_up_in_order(spark, sf):
    assert agrees(spark, sf, "index_heatmap")


def test_rgb_composite_adds_up_in_order(spark, sf):
    assert agrees(spark, sf, "rgb_composite")
