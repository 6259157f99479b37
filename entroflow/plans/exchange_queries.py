"""Queries on packed results and on table functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import packed, rolling, tables
from . import result_queries  # noqa: F401  joint_synergy
from .queries import EXACT, HALF, JOINT, ORACLES, QUERIES, S6, STEP6, binned, query, rounded, wide

_VALUES = ("jte_bits", "sum_te", "synergy")
_TIMES = f"(SELECT epoch_us(min(ts)) - epoch_us(min(ts)) % {STEP6} FROM events) + (window_idx + {HALF}) * {STEP6}"
_STATS = "avg(jte_bits) OVER w AS mean_jte, avg(synergy) OVER w AS mean_synergy"


def _packed(spark, sf_dir):
    """Joint results of two targets in rows of at most 32 windows, as JSON text."""
    centres = wide(spark, sf_dir).select((F.col("idx") - HALF).alias("window_idx"), "us")
    joint = QUERIES["joint_synergy"](spark, sf_dir).join(centres, "window_idx")
    names = spark.createDataFrame([(t, list(s), {"tau": [1, 2]}, 1) for s, t in JOINT], "target string, input_vars array<string>, lags map<string, array<int>>, history_length int")
    stats = rolling.synergy_stats(joint.withColumns({c: F.col(c).cast(EXACT) for c in _VALUES}), ["target"]).select("target", F.struct("mean_jte", "mean_synergy").alias("synergy_stats"))
    about = names.join(stats, "target").withColumn("window_hours", F.lit(2 * HALF * 6))
    return packed.pack(joint, ["target"], _VALUES, about, part=32).withColumn("packed", F.to_json("packed"))


_INPUTS = " ".join(f"WHEN '{t}' THEN '{';'.join(s)}'" for s, t in JOINT)


@query(f"""SELECT target, CASE target {_INPUTS} END AS inputs, {2 * HALF * 6} AS window_hours, window_idx, {_TIMES} AS us, jte_bits, sum_te, synergy, round(mean_jte, 6) + 0e0 AS mean_jte, round(mean_synergy, 6) + 0e0 AS mean_synergy
FROM (SELECT *, {_STATS} FROM ({ORACLES['joint_synergy']}) WINDOW w AS (PARTITION BY target))""")
def packed_results(spark, sf_dir):
    """Packed, written as text, parsed and unpacked again."""
    p = packed.from_json(_packed(spark, sf_dir))
    get = lambda path, kind: packed.said(F.col("packed"), path, kind)
    p = p.select("target", "packed", F.array_join(get("input_vars", "array<string>"), ";").alias("inputs"), get("window_hours", "int").alias("window_hours"), get("synergy_stats.mean_jte", "double").alias("mean_jte"), get("synergy_stats.mean_synergy", "double").alias("mean_synergy"))
    keys = ["target", "inputs", "window_hours", "mean_jte", "mean_synergy"]
    return rounded(packed.unpack(p, keys, _VALUES), "mean_jte", "mean_synergy")


@query(f"WITH r AS (SELECT target, window_idx // 32 AS part, window_idx, jte_bits FROM ({ORACLES['joint_synergy']})) SELECT target, part, count(*) AS n, strftime(make_timestamp(min({_TIMES})), '%Y-%m-%d %H:%M:%S') AS first_time, round(max(jte_bits), 6) + 0e0 AS peak, 1 AS first_lag FROM r GROUP BY target, part")
def packed_paths(spark, sf_dir):
    """Single fields of packed rows by path."""
    p = packed.from_json(_packed(spark, sf_dir))
    get = lambda path, kind: F.variant_get("packed", path, kind)
    peak = F.round(F.array_max(get("$.jte_bits", "array<double>")), 6) + F.lit(0.0)
    return p.select("target", get("$.part", "bigint").alias("part"), F.size(get("$.windows", "array<bigint>")).cast("long").alias("n"), get("$.timestamps[0]", "string").alias("first_time"), peak.alias("peak"), get("$.about.lags.tau[0]", "int").alias("first_lag"))


#: Bins of one series that a window of surrogates_in_sql holds, without overlap.
_WINDOW = 40


@query(f"""WITH {S6}, v AS (SELECT series, idx // {_WINDOW} AS win, round(value, 6) AS value FROM s6 WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY series, win ORDER BY value) AS place FROM v)
SELECT series, win, CAST(replicate AS INTEGER) AS replicate, place, value + 0e0 AS value FROM r CROSS JOIN (SELECT unnest([0, 1, 2]) AS replicate)""")
def surrogates_in_sql(spark, sf_dir):
    """Shuffled surrogates by name in SQL text: each holds its window's values, in another order."""
    tables.register(spark)
    binned(spark, sf_dir).select(F.concat_ws("|", "series", F.expr(f"idx div {_WINDOW}")).alias("name"), "value", "idx").createOrReplaceTempView("surrogate_windows")
    return spark.sql("""SELECT split(key, '[|]')[0] AS series, cast(split(key, '[|]')[1] AS bigint) AS win, replicate, cast(row_number() OVER (PARTITION BY key, replicate ORDER BY value) AS bigint) AS place, round(value, 6) + 0D AS value
FROM surrogate_series(TABLE(surrogate_windows) PARTITION BY (name) ORDER BY (idx), 'shuffle', 3, 7) WHERE value IS NOT NULL""")
