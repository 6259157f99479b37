"""Two-level scans, ranks by ranges and sliding medians against plain loops, with a series over many blocks and a hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from entroflow.operators import align, normalize, ranks, scan, stats


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(scan, "SPAN", 7)
    monkeypatch.setattr(scan, "MEDIANS", 9)
    monkeypatch.setattr(ranks, "RANGE", 20)
    monkeypatch.setattr(ranks, "HELD", 10)


def series(seed=1):
    """{key: [(idx, value)]}: long runs over many blocks, gaps at the ends and inside, a key of gaps only, a null key, places left out."""
    rng = np.random.default_rng(seed)
    out = {}
    for key, n in (("long", 150), ("b", 23), (None, 30), ("one", 1), ("none", 12)):
        v, on = [], True
        while len(v) < n:
            on = not on
            v += [float(rng.integers(0, 9)) if on and key != "none" else None for _ in range(int(rng.integers(1, 25)))]
        places = np.arange(n) + (np.arange(n) > n // 2) * 16
        out[key] = list(zip(places.tolist(), v[:n]))
    return out


def frame(spark, data):
    rows = [(k, i, i * align.HOUR, v) for k, r in data.items() for i, v in r]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([(k, int(i), int(u), None if v is None else float(v)) for k, i, u, v in rows], "k string, idx long, us long, value double").repartition(5)


def test_runs_bridges_and_long_runs(spark):
    data = series()
    df = frame(spark, data)
    run = {(r.k, r.idx): r.run for r in align.runs(df, F.col("value").isNull(), "idx", ["k"]).collect()}
    kept = {(r.k, r.idx): r.active for r in stats.long_runs(stats.bridged(df, F.col("value") > 2, ["k"], 3), ["k"], 4).collect()}
    for k, rows in data.items():
        number, want = 0, []
        for j, (i, v) in enumerate(rows):
            number += j == 0 or (v is None) != (rows[j - 1][1] is None)
            want.append(number)
        assert [run[k, i] for i, _ in rows] == want
        on = [v is not None and v > 2 for _, v in rows]

        def parts(flags):
            cuts = [0, *(j for j in range(1, len(flags)) if flags[j] != flags[j - 1]), len(flags)]
            return list(zip(cuts, cuts[1:]))

        first = parts(on)
        for n, (a, b) in enumerate(first):
            if 0 < n < len(first) - 1 and b - a <= 3:
                on[a:b] = [True] * (b - a)
        for a, b in parts(on):
            if b - a < 4:
                on[a:b] = [False] * (b - a)
        assert [kept[k, i] for i, _ in rows] == on
    whole = stats.long_runs(df.withColumn("active", F.lit(True)), [], 10)
    assert whole.where("active AND run = 1").count() == df.count() and stats.long_runs(df.where("false").withColumn("active", F.lit(True)), ["k"], 1).count() == 0


def test_gaps_and_lines(spark):
    data = series(2)
    df = frame(spark, data)
    got = sorted((str(r.k), r.first_idx, r.last_idx, r.n_missing, r.gap_hours) for r in align.gaps(df, ["k"]).collect())
    filled = {(r.k, r.idx): r.filled for r in align.interpolate(df, None, ["k"]).collect()}
    want = []
    for k, rows in data.items():
        there = [j for j, (_, v) in enumerate(rows) if v is not None]
        for a, b in zip(there, there[1:]):
            if b > a + 1:
                want.append((str(k), rows[a + 1][0], rows[b - 1][0], b - a - 1, float(rows[b][0] - rows[a + 1][0])))
        line = np.interp([i for i, _ in rows], [rows[j][0] for j in there], [rows[j][1] for j in there], np.nan, np.nan) if there else [np.nan] * len(rows)
        assert [np.nan if filled[k, i] is None else filled[k, i] for i, _ in rows] == pytest.approx(list(line), nan_ok=True)
    assert got == sorted(want)


@pytest.mark.parametrize("n", [3, 8, 25])
def test_sliding_medians(spark, n):
    data = series(3)
    out = stats.rolling_median(frame(spark, data), ["k"], n, least=2)
    assert out.where("k = 'long'").select(F.spark_partition_id()).distinct().count() > 1
    got = {(r.k, r.idx): r.baseline for r in out.collect()}
    assert len(got) == sum(map(len, data.values()))
    for k, rows in data.items():
        v = [x for _, x in rows]
        for j, (i, _) in enumerate(rows):
            held = [x for x in v[max(0, j - n // 2) : j + n - n // 2] if x is not None]
            assert got[k, i] == (None if len(held) < 2 else pytest.approx(float(np.median(held))))


def test_ranks_and_quantiles_of_a_hot_key(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.normal(size=600)] + [("hot", 0.5)] * 300 + [("b", float(v)) for v in rng.integers(0, 4, 50)] + [(None, 1.0), (None, 2.0), ("none", None), ("b", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(4)
    sizes = [r["count"] for r in ranks.ranges(df, ["k"], "value").groupBy("_range").count().collect()]
    assert len(sizes) > 15 and max(sizes) <= 5 * ranks.RANGE
    probs = {"q0": 0.0, "q1": 0.25, "half": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.k: [r[p] for p in probs] for r in ranks.quantiles(df, ["k"], "value", probs).collect()}
    ranked = sorted((str(r.k), r.value, r.rank) for r in ranks.with_ranks(df.where("value IS NOT NULL"), ["k"], "value").collect())
    want = []
    for k in ("hot", "b", None, "none"):
        x = np.array([a for key, a in rows if key == k and a is not None])
        assert got[k] == ([None] * 5 if not len(x) else pytest.approx(list(np.quantile(x, list(probs.values())))))
        want += [(str(k), a, (x < a).sum() + ((x == a).sum() + 1) / 2) for a in x]
    assert ranked == sorted(want)
    assert ranks.quantiles(df.where("k = 'hot'"), [], "value", {"m": 0.5}).first().m == pytest.approx(np.median([a for k, a in rows if k == "hot"]))
    assert ranks.with_ranks(df, ["k"], "value").where("value IS NULL AND rank IS NULL").count() == 2


def test_spearman_and_top(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 30, 400), rng.integers(0, 30, 400)
    df = spark.createDataFrame([(int(x), int(x + y)) for x, y in zip(a, b)], "a int, b int")
    order = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    assert stats.spearman(df, "a", "b").first().rho == pytest.approx(np.corrcoef(order(a), order(a + b))[0, 1])
    top = [x >= np.quantile(x, 0.9) for x in (a, a + b)]
    assert stats.top_jaccard(df, "a", "b").first().jaccard == pytest.approx((top[0] & top[1]).sum() / (top[0] | top[1]).sum())


def test_scale_and_inequality_of_a_hot_key(spark):
    rng = np.random.default_rng(6)
    data = {"hot": [*rng.normal(size=400), *[0.25] * 200], "b": [*rng.integers(-2, 5, 60)], "flat": [3.0] * 12, "one": [2.0], "none": [None], None: [1.0, 4.0, 9.0]}
    rows = [(k, i, None if x is None else float(x)) for k, v in data.items() for i, x in enumerate(v)] + [("b", 60, None)]
    df = spark.createDataFrame(rows, "k string, us long, value double").repartition(4)
    scale = {r.k: r for r in normalize.robust_scale(df, "value", ["k"]).collect()}
    stat = {r.k: r for r in stats.series_stats(df, ["k"]).collect()}
    text = {r.k: r for r in stats.describe(df, ["k"]).collect()}
    z = normalize.robust_zscore(df, "value", ["k"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in z} == {k: len(v) + (k == "b") for k, v in data.items()}
    assert scale["none"]._n == 0 and scale["none"]._median is None and "none" not in stat
    for k, v in data.items():
        if k == "none":
            continue
        x = np.array(v, float)
        q1, half, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        assert [scale[k]._n, scale[k]._median, scale[k]._mad, scale[k]._iqr] == pytest.approx([len(x), half, np.median(np.abs(x - half)), q3 - q1])
        assert [text[k].q1, text[k].median, text[k].q3, text[k].iqr] == pytest.approx([q1, half, q3, q3 - q1])
        c, n = np.sort(np.maximum(x, 0)), len(x)
        assert stat[k].gini == pytest.approx(2 * (np.arange(1, n + 1) * c).sum() / (n * c.sum()) - (n + 1) / n)
    turned = normalize.circular_components(df.where("value IS NOT NULL AND k IN ('hot', 'b')").withColumn("value", F.col("value") * 40), "value", ["k"]).collect()
    for k in ("hot", "b"):
        angle = np.radians(np.array(data[k], float) * 40)
        off = np.stack([np.sin(angle) - np.median(np.sin(angle)), np.cos(angle) - np.median(np.cos(angle))])
        want = off * 0.6745 / np.median(np.abs(off))
        got = np.array([(r["sin"], r["cos"]) for r in sorted((r for r in turned if r.k == k), key=lambda r: r.us)]).T
        assert got == pytest.approx(want)
