"""Results that lie on a tie of the last place kept."""

from pyspark.sql import functions as F

from entroflow.plans import exchange_queries, queries, rolling


def _tested(spark, values):
    te = spark.createDataFrame([("view", "click", 0, 0, 0.01)], "target string, entity string, window_idx long, us long, te_bits double")
    drawn = spark.createDataFrame([("view", "click", 0, v) for v in values], "target string, entity string, window_idx long, te_bits double")
    te, drawn = (d.withColumn("te_bits", F.col("te_bits").cast(queries.EXACT)) for d in (te, drawn))
    return rolling.significance(te, drawn)


def test_mean_of_replicates_is_exact(spark):
    """40 values of six places whose mean ends in 5: in doubles it came out lower in any order."""
    for order in (1, -1):
        s = _tested(spark, ([0.074648] * 38 + [0.288638] * 2)[::order])
        assert queries.rounded(s, "surr_mean").first().surr_mean == 0.085348


def test_quantiles_as_sql_has_them(spark):
    """DuckDB's round(quantile_cont(v, 0.975), 6) of these 40 values is 0.081793."""
    s = _tested(spark, [0.089847] + [0.081587] * 39)
    assert queries.rounded_as_sql(s, "upper_ci").first().upper_ci == 0.081793


def test_packed_means_are_exact(spark, sf_dir, monkeypatch):
    """80 values of four places whose mean ends in 5 behind the sixth: in doubles it came out lower in any order."""
    values = [0.7365] * 78 + [0.7738] * 2
    rows = [("view", i, v, v, v) for i, v in enumerate(values)]
    joint = spark.createDataFrame(rows, "target string, window_idx long, jte_bits double, sum_te double, synergy double")
    monkeypatch.setitem(queries.QUERIES, "joint_synergy", lambda spark, sf_dir: joint)
    monkeypatch.setattr(exchange_queries, "wide", lambda spark, sf_dir: spark.range(200).select(F.col("id").alias("idx"), F.lit(0).cast("long").alias("us")))
    got = exchange_queries.packed_results(spark, sf_dir).select("mean_jte", "mean_synergy").distinct().collect()
    assert [tuple(r) for r in got] == [(0.737433, 0.737433)]
