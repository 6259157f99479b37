"""Neighbours by leaves against all pairs, and permutation tests that don't spread rows over replicates."""

import numpy as np
import pytest

from entroflow.functions import knn, near
from entroflow.plans import estimates


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("kind", ["plain", "ties", "outliers"])
def test_same_as_all_pairs(dims, kind):
    r = np.random.default_rng(dims)
    a, b = r.normal(size=(900, dims)), r.normal(size=(1300, dims))
    if kind == "ties":
        a, b = np.round(a, 1), np.round(b, 1)
    if kind == "outliers":
        a[:5], b[:400] = 50.0, b[0]
    d = np.abs(a[:, None] - b[None]).max(axis=2)
    want = np.sort(d, axis=1)
    assert np.array_equal(near.nearest(a, b, 4)[0], want[:, :4])
    for reach in (want[:, 3], want[:, 3] - 1e-15, np.where(np.arange(900) % 3, 0.5, np.nan)):
        assert np.array_equal(near.within(a, b, reach), (d <= reach[:, None]).sum(axis=1))


def test_measures_of_arrays():
    x, y, z = np.random.default_rng(0).normal(size=(3, 400, 1))
    assert near.information(x, y) == pytest.approx(knn.mutual_information(x, y))
    assert near.information(x, y, z) == pytest.approx(knn.mutual_information(x, y, z))
    assert near.mixed_information(x, (y > 0).astype(float)) == pytest.approx(knn.mixed_information(x, y.ravel() > 0))


def test_replicates_are_drawn_in_tasks(spark, monkeypatch):
    """Rows used to be written once a replicate, whatever the size of their key; larger keys still are, with the same results."""
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i % 2, i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(240, 2)))], "k int, id long, x double, y double")
    read = lambda: sorted(tuple(round(v, 9) for v in row) for row in estimates.shuffle_test(df, ["k"], "id", ["x"], ["y"], ns=12).collect())
    spread = []
    old = estimates.materialize
    monkeypatch.setattr(estimates, "materialize", lambda d, label: spread.append(label) or old(d, label))
    held = read()
    assert "shuffled" not in spread and len(held) == 2
    monkeypatch.setattr(estimates, "HELD", 100)
    assert read() == held and "shuffled" in spread
