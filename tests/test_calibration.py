"""Calibration on tables of any size, against the kernel on the driver."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from entroflow.operators import normalize, ranks
from entroflow.plans import estimates


def table(spark, n, rng):
    x, u = rng.normal(size=n), rng.normal(size=n)
    d = pd.DataFrame({"i": np.arange(n), "t": x + u + 0.3 * rng.normal(size=n), "x": x * 5 + 2, "u": u})
    return spark.createDataFrame(d).withColumn("u", F.when(F.col("i") % 11 != 4, F.col("u")))


@pytest.mark.parametrize("base", [2.0, 10.0])
def test_same_as_the_kernel(spark, base):
    d = table(spark, 400, np.random.default_rng(3))
    want = normalize.beta_calibration(d, "t", ["x", "u"], 4, base)
    got = estimates.calibration(d, "i", "t", ["x", "u"], 4, base)
    assert got.keys() == want.keys() and got["inputs"] == ["x", "u"]
    for name in ("jmi_bits", "entropy_bits", "scale"):
        assert got[name] == pytest.approx(want[name], rel=1e-9)


def test_blocks_and_ranges(spark, monkeypatch):
    # Neither one block of neighbours nor one aggregation holds all rows.
    d = table(spark, 6000, np.random.default_rng(4))
    want = normalize.beta_calibration(d, "t", ["x", "u"], most=6000)
    monkeypatch.setattr(ranks, "HELD", 1000)
    got = estimates.calibration(d, "i", "t", ["x", "u"])
    assert got["scale"] == pytest.approx(want["scale"], rel=1e-9)


def test_errors(spark):
    d = table(spark, 60, np.random.default_rng(5))
    with pytest.raises(ValueError, match="complete rows"):
        estimates.calibration(d.where("i < 12"), "i", "t", ["x", "u"])
    with pytest.raises(ValueError, match="constant"):
        estimates.calibration(d.withColumn("x", F.lit(1.0)), "i", "t", ["x"])
    with pytest.raises(ValueError, match="complete rows, not 0"):
        estimates.calibration(d.limit(0), "i", "t", ["x"])
