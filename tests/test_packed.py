"""Packed results and the table function of surrogates."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from entroflow.functions import surrogates
from entroflow.plans import packed, tables

HOUR = 3_600_000_000


def test_round_trip(spark):
    rows = [("a", i, 1_700_000_000_000_000 + i * HOUR, None if i == 3 else float("nan") if i == 5 else i / 3, 1e-9 * i) for i in range(25)]
    rows += [(None, 0, 1_700_000_000_000_000, 1.0, -2.5), ("a", None, 0, 1.0, 1.0), ("b", 7, 1_700_000_000_000_000, 0.1, 1e300)]
    df = spark.createDataFrame(rows, "k string, window_idx long, us long, te double, packed double")
    about = spark.createDataFrame([("a", "view", {"x": 2}), (None, "none", {})], "k string, target string, lags map<string, int>")
    made = packed.pack(df, ["k"], ["te", "packed"], about, part=10)
    assert made.count() == 5
    text = made.select("k", F.to_json("packed").alias("packed"))
    first = next(d for r in text.collect() if r.k == "a" for d in [json.loads(r.packed)] if d["part"] == 0)
    assert first["timestamps"][:2] == ["2023-11-14 22:13:20", "2023-11-14 23:13:20"] and first["windows"] == list(range(10)) and first["about"] == {"lags": {"x": 2}, "target": "view"}
    want = sorted((str(k), w, us, None if te is None or np.isnan(te) else te, p) for k, w, us, te, p in rows if w is not None)
    for back in (made, packed.from_json(text)):
        got = packed.unpack(back, ["k"], ["te", "packed"]).collect()
        assert sorted((str(r.k), r.window_idx, r.us, r.te, r.packed) for r in got) == want
        assert {(r.k, r[1], r[2]) for r in back.select("k", packed.said(F.col("packed"), "target", "string"), packed.said(F.col("packed"), "lags.x", "int")).collect()} == {("a", "view", 2), (None, "none", None), ("b", None, None)}
    assert packed.unpack(made, ["k"], ["absent"]).where("absent IS NULL").count() == len(want)
    assert packed.from_json(spark.createDataFrame([("no json",)], "packed string")).where("packed IS NULL").count() == 1
    assert packed.unpack(packed.pack(df.limit(0), ["k"], ["te"], about), ["k"], ["te"]).count() == 0


@pytest.mark.parametrize("kind", sorted(surrogates.KINDS))
def test_surrogates_by_name(spark, kind):
    tables.register(spark)
    x = np.random.default_rng(1).normal(size=60)
    rows = [(k, i, None if k == "c" or (k == "b" and i == 9 and kind == "shuffle") else float(v + i / 9)) for k in "abc" for i, v in enumerate(x)]
    spark.createDataFrame(rows, "k string, i int, v double").select("k", "v", "i").repartition(4, "i").createOrReplaceTempView("udtf_series")
    read = lambda: sorted(map(tuple, spark.sql(f"SELECT * FROM surrogate_series(TABLE(udtf_series) PARTITION BY (k) ORDER BY (i), '{kind}', 3, 5)").collect()), key=str)
    got = read()
    assert got == read() and {r[0] for r in got} == {"a", "b"} and len(got) == 2 * 3 * 60
    one = [[r[3] for r in sorted(got, key=lambda r: r[2]) if r[0] == "a" and r[1] == j] for j in range(3)]
    assert len({tuple(o) for o in one}) == 3
    plain = [r[2] for r in rows if r[0] == "a"]
    if kind != "phase":
        # A permutation of few blocks may be the identity.
        assert all(np.allclose(sorted(o), sorted(plain)) for o in one) and any(o != plain for o in one)
    else:
        assert all(np.allclose(np.abs(np.fft.rfft(o))[1:-1], np.abs(np.fft.rfft(plain))[1:-1]) for o in one)
    if kind == "shuffle":
        assert [r[2] for r in got if r[0] == "b" and r[3] is None] == [9, 9, 9]


def test_running_moments_over_batches(spark, tmp_path):
    from entroflow.streaming import resample

    values = [[1e9 + i for i in range(5)], [None, None], [1e9 - 7.5, None, 1e9 + 100]]
    src, seen = str(tmp_path / "in"), {}
    for part in values:
        spark.createDataFrame([("k", v) for v in part] + [("empty", None)], "k string, v double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(src)
    q = resample.running_moments(stream, "k", "v").writeStream.outputMode("update").foreachBatch(lambda d, i: seen.update({r.k: r for r in d.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    every = np.array([v for part in values for v in part if v is not None])
    assert seen["k"].n == len(every) and seen["k"]["mean"] == pytest.approx(every.mean()) and seen["k"]["std"] == pytest.approx(every.std())
    assert tuple(seen["empty"]) == ("empty", 0, 0.0, 0.0)
