"""Estimators against closed forms, and surrogates against their invariants."""

import numpy as np
import pytest

from entroflow.functions import discrete, knn, surrogates


def test_digamma():
    assert knn.digamma(np.array([1, 2, 3])) == pytest.approx([-0.5772156649, 0.4227843351, 0.9227843351])


def test_small_example():
    assert knn.mutual_information([1.3, 3.7, 5.1, 2.4, 3.4], [1.5, 3.32, 5.3, 2.3, 3.3]) == pytest.approx(0.168, abs=1e-3)


def test_uniform_entropy():
    x = np.random.default_rng(0).uniform(0, 2, 1000)
    assert np.mean([knn.entropy(x, k) for k in range(1, 6)]) == pytest.approx(1, abs=0.1)


def test_gaussian_information():
    rng, rho = np.random.default_rng(1), 0.8
    found = []
    for _ in range(20):
        x = rng.normal(size=200)
        found.append(knn.mutual_information(x, rho * x + np.sqrt(1 - rho**2) * rng.normal(size=200)))
    assert np.mean(found) == pytest.approx(-0.5 * np.log2(1 - rho**2), abs=0.06)


def test_conditional_information_vanishes_on_a_chain():
    rng = np.random.default_rng(2)
    z = rng.normal(size=400)
    x, y = z + 0.5 * rng.normal(size=400), z + 0.5 * rng.normal(size=400)
    assert abs(knn.mutual_information(x, y, z)) < 0.1 < knn.mutual_information(x, y)


def test_divergence():
    rng = np.random.default_rng(3)
    a, b, c = rng.uniform(0, 2, 200), rng.uniform(0, 2, 300), rng.uniform(3, 5, 300)
    assert abs(knn.kl_divergence(a, b)) < 0.3 and knn.kl_divergence(a, c) > 3


def test_mixed_information():
    rng = np.random.default_rng(4)
    g = rng.integers(0, 2, 400)
    assert knn.mixed_information(g * 20 + rng.normal(size=400), g) == pytest.approx(1, abs=0.15)
    assert np.isfinite(knn.mixed_conditional_entropy(rng.normal(size=50), rng.integers(0, 2, 50)))


def test_families():
    rng = np.random.default_rng(5)
    sets = [(rng.normal(size=(300, 2)), rng.normal(size=300)) for _ in range(8)]
    assert abs(np.mean([knn.total_correlation(x) for x, _ in sets])) < 0.1
    assert abs(np.mean([knn.explained_correlation(x, y) for x, y in sets])) < 0.15
    assert abs(np.mean([knn.conditional_total_correlation(x, y) for x, y in sets])) < 0.2
    line = np.linspace(0, 1, 200) + 1e-6 * rng.normal(size=200)
    assert knn.mutual_information(line, line + 1e-4 * rng.normal(size=200), alpha=0.25) >= knn.mutual_information(line, line + 1e-4 * rng.normal(size=200)) - 0.5


def test_too_few():
    with pytest.raises(ValueError):
        knn.entropy([1.0, 2.0, 3.0])


def coupled(n=600, seed=6):
    rng = np.random.default_rng(seed)
    x, y = np.zeros(n), np.zeros(n)
    for t in range(1, n):
        x[t] = 0.5 * x[t - 1] + rng.normal()
        y[t] = 0.4 * y[t - 1] + 0.8 * x[t - 1] + 0.5 * rng.normal()
    return x, y


def test_transfer_has_a_direction():
    x, y = coupled()
    forth, back = knn.transfer_entropy([x], y, [1])[0], knn.transfer_entropy([y], x, [1])[0]
    assert forth > 0.5 > 0.15 > back


def test_missing_rows_are_left_out_before_lagging():
    x, y = coupled(200)
    gap = x.copy()
    gap[50:60] = np.nan
    keep = ~np.isnan(gap)
    assert knn.transfer_entropy([gap], y, [1]) == knn.transfer_entropy([x[keep]], y[keep], [1])
    assert knn.transfer_entropy([x[:9]], y[:9], [1]) == (0.0, "short")


@pytest.mark.parametrize("kind", sorted(surrogates.KINDS))
@pytest.mark.parametrize("dims", [1, 2])
def test_surrogates(kind, dims):
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.normal(size=(121, dims)), axis=0)
    x[5] = np.nan
    s = surrogates.surrogate(x if dims > 1 else x[:, 0], kind, np.random.default_rng(1)).reshape(121, dims)
    again = surrogates.surrogate(x if dims > 1 else x[:, 0], kind, np.random.default_rng(1)).reshape(121, dims)
    assert np.array_equal(s, again, equal_nan=True)
    if kind != "block":
        assert np.isnan(s[5]).all()
    if kind in ("shuffle", "block"):
        assert sorted(s[~np.isnan(s[:, 0]), 0]) == sorted(x[~np.isnan(x[:, 0]), 0])


def test_iaaft_keeps_values_and_spectrum():
    x = np.cumsum(np.random.default_rng(8).normal(size=256))
    s = surrogates.surrogate(x, "iaaft", np.random.default_rng(2))
    assert np.allclose(np.sort(s), np.sort(x))
    a, b = np.abs(np.fft.rfft(x - x.mean())), np.abs(np.fft.rfft(s - s.mean()))
    assert np.corrcoef(a, b)[0, 1] > 0.99


def test_circle_stays_a_circle():
    t = np.random.default_rng(9).uniform(0, 2 * np.pi, 100)
    s = surrogates.surrogate(np.column_stack([np.cos(t), np.sin(t)]), "iaaft", np.random.default_rng(3))
    assert np.allclose(np.hypot(*s.T), np.hypot(*s.T).mean(), atol=0.05)
    assert np.array_equal(surrogates.surrogate(np.ones((20, 1)), "iaaft", np.random.default_rng(0)), np.ones((20, 1)))


def test_block_size_and_unknown_kind():
    assert surrogates.block_size(np.random.default_rng(0).normal(size=90)) == 2
    with pytest.raises(ValueError):
        surrogates.surrogate(np.zeros(5), "other", np.random.default_rng(0))


def test_exclusive_or(spark):
    rows = [(x, y, x ^ y) for x in (0, 1) for y in (0, 1)] * 2
    d = spark.createDataFrame(rows, "x int, y int, z int")
    assert discrete.entropy(d, ["x"]).first()[0] == pytest.approx(1)
    assert discrete.mutual_information(d, ["x"], ["y"]).first()[0] == pytest.approx(0)
    assert discrete.conditional_mutual_information(d, ["x"], ["y"], ["z"]).first()[0] == pytest.approx(1)


def test_significance_rests_on_a_hundred_surrogates(spark, sf_dir):
    from entroflow.plans import queries

    p = [r.p_value for r in queries.shuffle_significance(spark, sf_dir).select("p_value").collect() if r.p_value is not None]
    steps = {round(x * 100, 6) % 5 for x in p}
    assert p and len(steps) > 1
