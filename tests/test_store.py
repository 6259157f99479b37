"""Window results kept between runs."""

from pyspark.sql import functions as F

from entroflow.plans import catalog, queries, rolling, store
from entroflow.sources import scratch


def rows(df):
    return sorted(tuple(r) for r in df.select("target", "entity", "history", "window_idx", "us", "te_raw", "te_bits", "status").collect())


def test_only_missing_windows_are_computed(spark, sf_dir):
    grid = queries.wide(spark, sf_dir)
    e = [catalog.Entity("view", (("click", 1),)), catalog.Entity("signup", (("error", 1), ("wind", 2)), 2), catalog.Entity("view", (("error", 1),))]
    wind = {"wind": ["click", "purchase"]}
    path = scratch.path_for(spark, "store")
    run = lambda g, some=e, k=3: rows(store.rolling_te(g, some, 40, path, k, wind))
    held = lambda: store.read(spark, path).count()
    want = rows(rolling.rolling_te(grid, e, 40, vector_bases=wind))
    assert held() == 0 and run(grid, e[:1]) == [r for r in want if r[1] == "click__t1"]
    one = held()
    assert run(grid) == want and held() == len(want) == 3 * one
    assert run(grid) == want and held() == len(want)
    # One row of one column: the windows that hold it, of the entities that read it.
    other = grid.withColumn("click", F.when(F.col("idx") == 55, F.col("click") + 1).otherwise(F.col("click")))
    assert run(other) == rows(rolling.rolling_te(other, e, 40, vector_bases=wind)) and held() == len(want) + 2 * 40
    gap = grid.withColumn("error", F.when(F.col("idx") != 30, F.col("error")))
    assert run(gap) == rows(rolling.rolling_te(gap, e, 40, vector_bases=wind))
    before = held()
    assert run(grid) == want and held() == before
    assert run(grid, e[:1], 4) != [r for r in want if r[1] == "click__t1"] and held() == before + one
