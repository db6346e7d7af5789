"""The probe against numpy on whole arrays, reruns, and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquarry.operators import probe

DDL = "id long, label string, v array<double>"


def made(n=400, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, "abc"[i % 3], [float(x) for x in rng.normal(0, 0.4, 4) + np.eye(4)[i % 3]]) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), DDL)


def by_hand(spark, rows, epochs, batches, rate, decay, seed):
    """Whole-array AdamW with the batches that the keys say."""
    h = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    dealt = {r.id: -1 if r.held == 0 else r.batch for r in rows.select("id", h(10, 0).alias("held"), h(batches, 1).alias("batch")).collect()}
    data = sorted(tuple(r) for r in rows.collect())
    x = np.array([[*v, 1.0] for _, _, v in data])
    y = np.array(["abc".index(name) for _, name, _ in data])
    batch = np.array([dealt[i] for i, _, _ in data])
    w, m, s, t, losses, all_weights = np.zeros((3, 5)), 0.0, 0.0, 0, [], []

    def odds(part):
        e = np.exp(x[part] @ w.T)
        return e / e.sum(axis=1, keepdims=True)

    for epoch in range(epochs):
        for b in probe.batch_order(seed, epoch, batches):
            part = batch == b
            if part.any():
                g = (odds(part) - np.eye(3)[y[part]]).T @ x[part] / part.sum()
                t, m, s = t + 1, 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                w = w - rate * decay * w * [1, 1, 1, 1, 0] - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        held = batch == -1
        losses.append(-np.log(odds(held)[np.arange(held.sum()), y[held]]).mean())
        all_weights.append(w)
    return all_weights[int(np.argmin(losses))], losses


def test_against_numpy_and_reruns(spark, rows):
    how = dict(epochs=2, batches=3, rate=0.1, decay=0.02, seed=4)
    found = probe.fit(rows, "v", "label", "id", **how)
    weights, losses = by_hand(spark, rows, **how)
    assert np.allclose(found.weights, weights, atol=1e-5) and np.allclose(found.losses, losses, atol=1e-6)
    assert found.classes == ["a", "b", "c"] and found.epoch == int(np.argmin(losses))
    again = probe.fit(rows.repartition(7, "v").orderBy(F.desc("id")), "v", "label", "id", **how)
    assert (again.weights == found.weights).all() and again.losses == found.losses


def test_the_epoch_of_least_loss_is_kept_and_held_out_rows_are_told(spark, rows):
    wild = probe.fit(rows, "v", "label", "id", epochs=3, batches=2, rate=40.0)
    assert wild.epoch == int(np.argmin(wild.losses))
    test = spark.createDataFrame([(i, n, v) for i, n, v in made(150, 9)] + [(900, "a", None), (901, None, [1.0, 0.0, 0.0, 0.0]), (902, "a", [1.0])], DDL)
    found = probe.train_probe(rows, test, "v", "label", "id", batches=4, rate=0.2)
    assert found.where("label = predicted").count() > 0.85 * 150
    assert {r.id: r.predicted for r in found.where("id >= 900").collect()} == {900: None, 901: "a", 902: None}


def test_rows_that_take_no_part(spark, rows):
    odd = spark.createDataFrame([(1000, None, [1.0] * 4), (1001, "a", None), (1002, "z", [1.0, 2.0]), (1003, "z", [float("nan")] * 4), (1004, "z", [])], DDL)
    how = dict(epochs=1, batches=2)
    assert (probe.fit(rows.unionByName(odd), "v", "label", "id", **how).weights == probe.fit(rows, "v", "label", "id", **how).weights).all()
    for bad in (odd.where("id < 1002"), spark.createDataFrame([(1, "a", [1e9])], DDL)):
        with pytest.raises(ValueError):
            probe.fit(bad, "v", "label", "id")
    one = probe.fit(spark.createDataFrame([(1, "a", [1.0])], DDL), "v", "label", "id", epochs=2, batches=1)
    assert one.classes == ["a"] and one.weights.shape == (1, 2)
