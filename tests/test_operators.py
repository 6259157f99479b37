"""Sources, alignment, plans and streams on small made tables."""

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from entroflow.functions import knn
from entroflow.operators import align, normalize, stats
from entroflow.plans import attribution, catalog, estimates, rolling
from entroflow.sources import series
from entroflow.streaming import resample

T0 = dt.datetime(2024, 1, 1)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 06:00:00", float("nan"))], "name string, at string, v double")
    series.write_csv(df, str(tmp_path / "x"))
    back = series.load_csv(spark, str(tmp_path / "x"))
    assert series.detect_time_column(back) == "at" and series.numeric_columns(back) == ["v"]
    assert back.where("v IS NULL").count() == 1
    with pytest.raises(ValueError):
        series.require_columns(back, ["v", "w"])


def test_flux_log_and_dates(spark, tmp_path):
    (tmp_path / "flux_20240102.txt").write_text("date time a b c LE qc\n2024-01-02 00:00:00 1 2 3 5.5 0\n2024-01-02 00:30:00 1 2 3 -999 1\n")
    (tmp_path / "flux_20240301.txt").write_text("2024-03-01 00:00:00 1 2 3 7 0\n")
    log = series.read_flux_log(spark, str(tmp_path))
    assert sorted((r.value or 0, r.ts.hour) for r in log.collect()) == [(0, 7), (5.5, 7), (7.0, 7)]
    raw = spark.read.text(str(tmp_path))
    assert series.between_dates(raw, "20240101", "20240131").count() == 3


def test_reports():
    rows = [{"a": 1, "b": None}]
    assert "| 1 |  |" in series.markdown(rows, ["a", "b"]) and r"1 &  \\" in series.latex(rows, ["a", "b"]) and '"a": 1' in series.report_json(rows[0])


@pytest.mark.parametrize("centre,first", [("standard", 9), ("noon", 12), ("midnight", 12)])
def test_grid_begins(spark, centre, first):
    b = spark.createDataFrame([(T0 + dt.timedelta(hours=9, minutes=0), T0 + dt.timedelta(days=2))], "s timestamp_ntz, e timestamp_ntz")
    g = align.time_grid(b.select(align.micros(F.col("s")).alias("start"), align.micros(F.col("e")).alias("end")), 6, centre).orderBy("us").collect()
    assert (g[0].us // align.HOUR) % 24 == first and [r.idx for r in g] == list(range(len(g)))


def test_align_needs_distinct_columns(spark):
    a = spark.createDataFrame([(T0, 1.0)], "ts timestamp_ntz, x double")
    with pytest.raises(ValueError):
        align.align_datasets([(a, "ts"), (a, "ts")])
    with pytest.raises(ValueError):
        align.align_datasets([])


def test_constant_series(spark):
    d = spark.createDataFrame([(3.0,)] * 5, "value double")
    assert {r.z for r in normalize.robust_zscore(d).collect()} == {0.0}
    with pytest.raises(ValueError):
        normalize.robust_zscore(d, strict=True)


def test_beta_calibration(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    d = spark.createDataFrame(pd.DataFrame({"t": x + 0.3 * rng.normal(size=300), "x": x}))
    c = normalize.beta_calibration(d, "t", ["x"])
    assert c["jmi_bits"] > 1 and c["scale"] == pytest.approx(2 ** (c["jmi_bits"] - c["entropy_bits"]))
    with pytest.raises(ValueError):
        normalize.beta_calibration(d.limit(5), "t", ["x"])


def grid(spark, n=300):
    rng = np.random.default_rng(6)
    x, y = np.zeros(n), np.zeros(n)
    for t in range(1, n):
        x[t] = 0.5 * x[t - 1] + rng.normal()
        y[t] = 0.4 * y[t - 1] + 0.8 * x[t - 1] + 0.5 * rng.normal()
    return spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "us": np.arange(n) * align.HOUR, "x": x, "y": y, "g": "k"}))


def test_windows_cover_all_centres(spark):
    te = rolling.rolling_te(grid(spark), [catalog.Entity("y", (("x", 1),)), catalog.Entity("x", (("y", 1),)), catalog.Entity("x", (("x", 1),))], 100, keys=["g"]).toPandas()
    assert sorted(te[te.target == "y"].window_idx) == list(range(200)) and len(te) == 400
    assert te[te.target == "y"].te_bits.mean() > 0.4 > te[te.target == "x"].te_bits.mean()


def test_surrogates_tell_direction(spark):
    g, e = grid(spark, 130), [catalog.Entity("y", (("x", 1),))]
    sig = rolling.significance(rolling.rolling_te(g, e, 100), rolling.surrogate_te(g, e, 100, 20, "shuffle")).toPandas()
    assert len(sig) == 30 and sig.sig95.mean() > 0.9 and (sig.n_valid == 20).all()


def test_synergy_labels(spark):
    te = spark.createDataFrame([("t", 1, "a__t0+b__t0", 0, 0, 1.0), ("t", 1, "a__t0", 0, 0, 0.3), ("t", 1, "b__t0", 0, 0, 0.2)], "target string, history int, entity string, window_idx long, us long, te_bits double")
    r = rolling.synergy(te).first()
    assert r.label == "SYNERGISTIC" and r.synergy == pytest.approx(0.5)


def samples(spark, n=150, keys=2):
    rng = np.random.default_rng(8)
    rows = [(g, i, *(float(v) for v in rng.normal(size=3)), i % 2) for g in range(keys) for i in range(n)]
    rows = [(g, i, a, 0.7 * a + b, c + 0.3 * a, s) for g, i, a, b, c, s in rows]
    return spark.createDataFrame([*rows, (0, 9999, None, 1.0, 1.0, 0)], "g int, i long, x double, y double, z double, side int")


@pytest.mark.parametrize("block", [2000, 40])
def test_estimators_by_blocks_are_the_array_kernels(spark, monkeypatch, block):
    monkeypatch.setattr(estimates, "ROWS", block)
    d = samples(spark)
    want = {}
    for g, part in d.dropna().toPandas().groupby("g"):
        x, y, z, side = (part[c].to_numpy() for c in ("x", "y", "z", "side"))
        both = np.column_stack([x, y])
        want[g] = [knn.entropy(both), knn.mutual_information(x, y), knn.mutual_information(x, y, z), knn.mutual_information(x, y, alpha=0.25), knn.kl_divergence(both[side == 0], both[side == 1]), knn.mixed_information(x, side)]
    key = (["g"], "i")
    e = {r.g: (r.h, r.a, r.n) for r in estimates.entropies(d, *key, {"h": ["x", "y"], "a": ["x"]}).collect()}
    mi = {r.g: r.mi for r in estimates.information(d, *key, ["x"], ["y"]).collect()}
    cmi = {r.g: r.mi for r in estimates.information(d, *key, ["x"], ["y"], ["z"]).collect()}
    lnc = {r.g: r.lnc for r in estimates.corrections(d, *key, ["x", "y"], 0.25).collect()}
    kl = {r.g: r.kl for r in estimates.divergence(d.dropna(), *key, ["x", "y"], "side").collect()}
    given = {r.g: r.a for r in estimates.given_groups(d.dropna(), *key, {"a": ["x"]}, "side").collect()}
    for g in want:
        assert [e[g][0], mi[g], cmi[g], mi[g] + lnc[g], kl[g], abs(e[g][1] - given[g])] == pytest.approx(want[g], abs=1e-9)
    assert e[0][2] == 150 and estimates.entropies(d.where("false"), *key, {"h": ["x"]}).count() == 0


def test_shuffle_test(spark):
    r = estimates.shuffle_test(samples(spark, 80, 1), ["g"], "i", ["x"], ["y"], ns=20).first()
    assert r.low <= r["mean"] <= r.high and abs(r["mean"]) < 0.2


def test_shuffle_test_of_another_measure(spark):
    d = samples(spark, 60, 1).dropna()
    seen = []

    def mean_product(rows, keys):
        seen.append(rows.columns)
        return rows.groupBy(*keys).agg(F.avg(F.col("x") * F.col("side")).alias("mi"))

    r = estimates.shuffle_test(d, ["g"], "i", ["x"], ["side"], ns=40, measure=mean_product).first()
    rows = d.toPandas().sort_values("i")
    x, side, i = (rows[c].to_numpy() for c in ("x", "side", "i"))
    drawn = [(x[sorted(range(len(i)), key=lambda j: (hashlib.md5(f"{i[j]}:{rep}".encode()).hexdigest(), i[j]))] * side).mean() for rep in range(40)]
    assert seen and (r["mean"], r.low, r.high) == pytest.approx((np.mean(drawn), sorted(drawn)[1], sorted(drawn)[39]))


def test_mixed_correlations_are_the_published_ones(spark):
    d = samples(spark, 90, 2).withColumn("part", F.expr("cast(i % 3 as int)")).withColumn("rare", F.expr("if(i < 2, 1, 0)"))
    for groups in (["side", "part"], ["side", "rare"]):
        got = {r.g: (r.h_given, r.ctc, r.corex) for r in estimates.mixed_correlations(d, ["g"], "i", ["x", "y"], groups).collect()}
        for g, rows in d.dropna(subset=["x"]).toPandas().groupby("g"):
            x = rows[["x", "y"]].to_numpy()
            code = [rows[c].to_numpy() for c in groups]
            both = code[0] * 10 + code[1]
            given = [knn.mixed_conditional_entropy(x, c) for c in (*code, both)]
            bits = [-sum(p * np.log2(p) for p in np.unique(c, return_counts=True)[1] / len(c)) for c in (*code, both)]
            ctc = given[0] + given[1] - given[2]
            assert got[g] == pytest.approx((given[2], ctc, bits[0] + bits[1] - bits[2] - ctc), abs=1e-9)
    assert estimates.mixed_correlations(d.where("false"), ["g"], "i", ["x"], ["side", "part"]).count() == 0


def test_stage2_names_windows_that_fail(spark):
    g = grid(spark, 80).withColumn("y", F.when(F.col("idx") >= 20, F.col("y")))
    s = rolling.stage2(g, [catalog.Entity("y", (("x", 1),))], 20, 3)
    rows = {r.window_idx: r for r in s.collect()}
    assert rows[0].error == "short" and rows[0].te_bits is None and rows[0].surr_p95 is None
    last = rows[max(rows)]
    assert last.error is None and last.te_bits is not None and last.n_valid == 3 and last.surr_p95_pct is not None


def test_layers_and_artifacts(spark, tmp_path):
    t = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0, 2.0), ("b", "2024-01-02 00:00:00", None, 3.0)], "target string, at string, v double, w double").withColumn("at", F.to_timestamp("at"))
    series.write_layers(t, f"file://{tmp_path}/layers.parquet")
    back = series.load_series(spark, f"file://{tmp_path}/layers.parquet", ["v", "target"], before="2024-01-02")
    assert [tuple(r)[1:] for r in back.collect()] == [(1.0, "a")]


def test_family_level_is_withheld(spark):
    s = spark.createDataFrame([("t", "a", 0, 0, 1.0), ("t", "b", 0, 0, 2.0), ("u", "a", 0, 0, 3.0)], "target string, entity string, window_idx long, us long, surr_p95 double")
    assert [(r.target, r.level) for r in rolling.family_level(s, 2).collect()] == [("t", 2.0)] and rolling.family_level(s).count() == 2


def test_selection_rules(spark):
    t = spark.createDataFrame([(f"e{i}", float(i), float(-i)) for i in range(6)], "entity string, mean double, cv double")
    assert sorted(map(tuple, attribution.panels(t, 2).collect())) == [("e0", "episodic"), ("e1", "episodic"), ("e4", "persistent"), ("e5", "persistent")]
    one = spark.createDataFrame([("s", 0, 5.0)], "k string, idx long, value double")
    assert [r.value for r in align.to_length(one, 3, ["k"]).orderBy("i").collect()] == [5.0] * 3


def test_entities():
    e = catalog.Entity.parse("a__t0+b__t12", "y")
    assert e.sources == (("a", 0), ("b", 12)) and e.name == "a__t0+b__t12"
    for bad in ("a__t0+a__t1", "a", "a__tx"):
        with pytest.raises(ValueError):
            catalog.Entity.parse(bad, "y")
    with pytest.raises(ValueError):
        catalog.Settings(history=-1)


def test_episode_bridging(spark):
    v = [0, 0, 5, 5, 0, 5, 5, 0, 0, 5, 0, 0]
    d = spark.createDataFrame([(i, float(x), "k") for i, x in enumerate(v)], "idx long, value double, k string")
    found = stats.episodes(stats.episode_rows(d, ["k"], 1.0, 3, 1), ["k"]).collect()
    assert [(r.first_idx, r.last_idx, r.peak_idx) for r in found] == [(2, 6, 2)]


def test_pick_winners(spark):
    rows = [("p", "a__t0", ["a"], 5.0, 1.0, None), ("p", "a__t1", ["a"], 4.9, 1.0, None), ("p", "a__t0+b__t0", ["a", "b"], 5.1, 1.0, 0.1), ("p", "c__t0", ["c"], 4.0, 1.0, None), ("p", "d__t0", ["d"], 1.0, 1.0, None)]
    s = spark.createDataFrame(rows, "period string, entity string, bases array<string>, score double, floor double, gain double")
    assert [(r.slot, r.entity, r.raw_rank) for r in attribution.pick_winners(s).orderBy("slot").collect()] == [(1, "a__t0", 2), (2, "c__t0", 4)]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), []
    rows = [(T0 + dt.timedelta(hours=h), "k", float(h)) for h in range(12)]
    spark.createDataFrame(rows, "ts timestamp_ntz, k string, v double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp_ntz, k string, v double").parquet(src)
    q = resample.windowed_sums(stream, "ts", "v", ["k"]).writeStream.outputMode("complete").foreachBatch(lambda d, i: out.extend(d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.total for r in out) == [15.0, 51.0]
    seen = []
    q = resample.running_moments(stream, "k", "v").writeStream.outputMode("update").foreachBatch(lambda d, i: seen.extend(d.collect())).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen[-1].n == 12 and seen[-1]["mean"] == pytest.approx(5.5) and seen[-1]["std"] == pytest.approx(np.std(np.arange(12)))


def test_block_length_looks_at_all_lags(spark):
    import numpy as np

    from entroflow.functions import surrogates
    from entroflow.operators import stats

    i = np.arange(1800)
    series = {"slow": np.sin(i / 450), "slower": i / 7.0, "fast": np.sin(i / 3), "short": i[:50] * 1.0, "middle": np.sin(i / 190), "flat": np.zeros(300)}
    df = spark.createDataFrame([(k, int(j), float(v)) for k, x in series.items() for j, v in enumerate(x)], "series string, idx long, value double")
    got = {r.series: r.block for r in stats.block_length(df, ["series"]).collect()}
    assert got == {k: surrogates.block_size(x) for k, x in series.items()}
    assert got["slow"] > 200 and got["slower"] > 200 and got["middle"] > 200
