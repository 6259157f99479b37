"""Compute-heavy groups use all cores, and what they give doesn't depend on how they are dealt."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from entroflow.functions import knn, surrogates
from entroflow.plans import catalog, dealing, estimates, queries, rolling


def shares(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


@pytest.fixture(scope="module")
def grid(spark, sf_dir):
    return queries.wide(spark, sf_dir)


ENTITIES = [catalog.Entity(b, ((a, 1),)) for a, b in queries.PAIRS]


def test_every_core_has_work(spark, grid):
    cores = spark.sparkContext.defaultParallelism
    for df in (rolling.rolling_te(grid, ENTITIES, 40), rolling.rolling_entropy(grid, list(queries.TYPES), 40), rolling.surrogate_te(grid, ENTITIES[:3], 40, 100, "shuffle")):
        assert len(shares(df)) >= min(cores, 3)
    own = shares(rolling.surrogate_te(grid, ENTITIES[:3], 40, 100, "shuffle"))
    assert len(own) >= cores and own[-1] <= 3 * sum(own) / len(own)


def test_many_series(spark, grid):
    """Keys of which one is null, and one has nine tenths of the rows."""
    long = grid.withColumn("key", F.lit("long"))
    short = grid.where("idx < 50").withColumn("key", F.lit(None).cast("string")).unionByName(grid.where("idx BETWEEN 60 AND 110").withColumn("key", F.lit("b")))
    both = rolling.rolling_te(long.unionByName(short), ENTITIES[:2], 40, keys=["key"])
    alone = {(r.entity, r.target, r.us): r.te_raw for r in rolling.rolling_te(grid, ENTITIES[:2], 40).collect()}
    rows = both.collect()
    assert {r.key for r in rows} == {"long", None, "b"} and len([r for r in rows if r.key is None]) == 2 * 10
    assert all(r.te_raw == alone[r.entity, r.target, r.us] for r in rows) and len([r for r in rows if r.key == "long"]) == len(alone)
    assert rolling.rolling_te(grid.where("idx < 10"), ENTITIES[:2], 40).count() == 0


def test_partitions_of_small_and_large_work(spark):
    cores = spark.sparkContext.defaultParallelism
    assert dealing.partitions(spark, 0, 0) == 1 and dealing.partitions(spark, 100, 3) == 3
    assert dealing.partitions(spark, 100, 1000) == 2 * cores and dealing.partitions(spark, 10**9, 10**6) == 200_000


@pytest.mark.parametrize("kind", sorted(surrogates.KINDS))
@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("n", [40, 121])
def test_replicates_are_those_drawn_alone(kind, dims, n):
    x = np.cumsum(np.random.default_rng(n + dims).normal(size=(n, dims)), axis=0)
    x[7, 0] = np.nan
    rngs = lambda: [np.random.default_rng([3, r]) for r in range(30)]
    together = surrogates.replicates(x, kind, rngs())
    for r, rng in enumerate(rngs()):
        assert np.allclose(together[r], surrogates.surrogate(x, kind, rng), rtol=0, atol=1e-9, equal_nan=True)
    assert surrogates.replicates(x, kind, []).shape == (0, n, dims)


@pytest.mark.parametrize("history", [0, 1, 2])
@pytest.mark.parametrize("gap", [False, True])
def test_batched_estimates_are_the_single_ones(history, gap):
    rng = np.random.default_rng(history)
    y, xs = rng.normal(size=60), [rng.normal(size=(60, 2)), rng.normal(size=(60, 1))]
    if gap:
        y[3] = xs[0][9, 1] = np.nan
    for kind in surrogates.KINDS:
        fake = [surrogates.replicates(x, kind, [np.random.default_rng(r) for r in range(25)]) for x in xs]
        want = [knn.transfer_entropy([f[r] for f in fake], y, [1, 2], history)[0] for r in range(25)]
        assert knn.transfer_entropies(fake, y, [1, 2], history) == pytest.approx(want, abs=1e-12)
    assert (knn.transfer_entropies([f[:, :8] for f in fake], y[:8], [1, 2], history) == 0).all()


# Neighbours by tree -----------------------------------------------------------------------------------------------------


def cloud(spark, n=4000, seed=3):
    """Clusters of very different density, a few far points, and repeated rows."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(40, 0.01, (n // 4, 2)), rng.uniform(-100, 100, (n // 4 - 20, 2)), np.repeat(rng.normal(size=(10, 2)), 2, axis=0)])
    return x, spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(x)], "g int, i long, x double, y double")


def test_tree_prunes_and_is_exact(spark, monkeypatch):
    monkeypatch.setattr(estimates, "ROWS", 100)
    x, df = cloud(spark)
    cut = estimates.blocks(df, ["g"], "i", ["x", "y"]).cache()
    box = {r.block: r for r in estimates.boxes(cut, ["g"], 2).collect()}
    assert len(box) >= 40 and max(r.n for r in box.values()) <= 300
    d = np.abs(x[:, None] - x[None]).max(axis=2)
    want = np.sort(d, axis=1)[:, 3]
    got = {r.i: r.e for r in estimates.kth_distances(df, ["g"], "i", {"e": ["x", "y"]}).collect()}
    assert np.array_equal([got[i] for i in range(len(x))], want)
    reach = df.select("g", "i").join(spark.createDataFrame([(i, float(e)) for i, e in enumerate(want)], "i long, reach double"), "i")
    far = estimates.asked(cut, reach, ["g"], "i", 2)
    compared = sum(r["count"] * box[r.other].n for r in far.groupBy("other").count().collect()) + sum(r.n**2 for r in box.values())
    assert compared < 0.2 * len(x) ** 2
    counts = {r.i: (r.a, r.b) for r in estimates.counts_within(df.join(reach, ["g", "i"]), ["g"], "i", "reach", {"a": ["x"], "b": ["x", "y"]}).collect()}
    dx = np.abs(x[:, None, 0] - x[None, :, 0])
    within = [(np.count_nonzero(m <= (want - knn.ROUNDING)[:, None], axis=1)) for m in (dx, d)]
    assert [counts[i] for i in range(len(x))] == list(zip(*(w.tolist() for w in within)))
    cut.unpersist()


def test_ties(spark):
    """Equal values: minus infinity, not a smaller sample; or told apart by a jitter."""
    rows = [(0, i, float(i % 20)) for i in range(100)] + [(1, i, 0.0 if i < 50 else float(np.random.default_rng(i).normal())) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, i long, x double")
    assert {r.g: r.h for r in estimates.entropies(df, ["g"], "i", {"h": ["x"]}).collect()} == {0: -np.inf, 1: -np.inf}
    apart = estimates.jittered(df, "i", ["x"])
    h = {r.g: r.h for r in estimates.entropies(apart, ["g"], "i", {"h": ["x"]}).collect()}
    assert all(np.isfinite(v) for v in h.values()) and h[1] < -5
    moved = apart.withColumnRenamed("x", "moved").join(df, ["g", "i"]).collect()
    assert all(0 <= r.moved - r.x < 1e-10 for r in moved) and len({r.moved for r in moved if r.g == 0}) == 100


def test_permutations_by_digest(spark):
    order = surrogates.DigestOrder("a:0")
    first, second = order.permutation(30), order.permutation(np.arange(5, 20))
    assert sorted(first) == list(range(30)) and sorted(second) == list(range(5, 20))
    assert list(first) == sorted(range(30), key=lambda p: hashlib.md5(f"a:0:0:{p}".encode()).hexdigest())
    assert list(second) == sorted(range(5, 20), key=lambda p: hashlib.md5(f"a:0:1:{p}".encode()).hexdigest())
    x = np.random.default_rng(0).normal(size=(40, 1))
    x[[3, 17]] = np.nan
    alone = surrogates.replicates(x, "shuffle", [surrogates.DigestOrder("w:2")])
    both = surrogates.replicates(x, "shuffle", [surrogates.DigestOrder("w:1"), surrogates.DigestOrder("w:2")])
    assert np.array_equal(alone[0], both[1], equal_nan=True) and np.isnan(both[:, [3, 17]]).all() and not np.array_equal(both[0], both[1], equal_nan=True)
    blocks = surrogates.replicates(x, "block", [surrogates.DigestOrder("w:3")])
    assert np.array_equal(np.sort(blocks[0, :, 0]), np.sort(x[:, 0]), equal_nan=True)
    grid = spark.createDataFrame([(i, i, float(i % 7), float(i % 5)) for i in range(30)], "idx long, us long, x double, y double")
    with pytest.raises(ValueError):
        rolling.surrogate_te(grid, [catalog.Entity("y", (("x", 1),))], 20, 2, "iaaft", digests=True)
