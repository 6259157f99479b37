"""Queries over the driver's tables, one or more for each operator, and the SQL with the same results.

Series: events by event_type, in 6-hour and hourly bins. Results are rounded to six places; times are microseconds.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import discrete
from ..operators import align, normalize, stats
from ..sources import scratch
from . import attribution, catalog, knn_sql, rolling

TYPES = ("click", "error", "purchase", "signup", "view")
STEP6, STEP1 = 6 * align.HOUR, align.HOUR
HALF = 20

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def rounded_as_sql(df: DataFrame, *columns: str) -> DataFrame:
    """Six places as SQL rounds doubles: by the millions, where `rounded` goes by a double's shortest digits; ties can differ."""
    up = lambda c: F.floor(F.abs(c) * 1e6) + F.when(F.abs(c) * 1e6 - F.floor(F.abs(c) * 1e6) >= 0.5, 1.0).otherwise(0.0)
    return df.withColumns({c: F.signum(c) * up(F.col(c)) / 1e6 + F.lit(0.0) for c in columns})


#: Means of rounded values often end in a 5 behind the last place kept; sums of decimals tell such ties in any order of rows.
EXACT = "decimal(28,14)"


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0e0 AS {c.split('.')[-1]}" for c in columns)


# Base series ---------------------------------------------------------------------------------------------------------


def binned(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """series, us, idx, value (sum, null in empty bins), n."""
    ev = load(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", "value")
    s = align.resample(ev, "ts", hours, [F.sum("value").alias("value"), F.count("value").alias("n")], ["series"])
    first = s.agg(F.min("us").alias("_a"))
    return s.join(F.broadcast(first)).withColumn("idx", F.expr(f"(us - _a) div {hours * align.HOUR}")).select("series", "us", "idx", "value", "n")


def _base(name: str, step: int) -> str:
    return f"""{name}_b AS (SELECT event_type AS series, epoch_us(ts) - epoch_us(ts) % {step} AS us, sum(value) AS value, count(value) AS n FROM events GROUP BY ALL),
{name}_l AS (SELECT min(us) AS a, max(us) AS b FROM {name}_b),
{name}_g AS (SELECT series, unnest(range(a, b + 1, {step})) AS us FROM (SELECT DISTINCT series FROM {name}_b) CROSS JOIN {name}_l),
{name} AS (SELECT series, us, (us - a) // {step} AS idx, value, n FROM {name}_g LEFT JOIN {name}_b USING (series, us) CROSS JOIN {name}_l)"""


S6, S1 = _base("s6", STEP6), _base("s1", STEP1)

Z6 = f"""{S6},
zm AS (SELECT series, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM s6 GROUP BY series),
za AS (SELECT series, quantile_cont(abs(value - med), 0.5) AS mad FROM s6 JOIN zm USING (series) GROUP BY series),
z6 AS (SELECT series, us, idx, CASE WHEN mad > 1e-8 THEN 0.6745e0 * (value - med) / mad WHEN iqr <> 0 THEN (value - med) / (iqr / 1.349e0) ELSE 0e0 END AS z
       FROM s6 JOIN zm USING (series) JOIN za USING (series))"""


def zscored(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    return normalize.robust_zscore(binned(spark, sf_dir, hours), "value", ["series"]).select("series", "us", "idx", "z")


def wide(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """idx, us and a z-scored column for each event type."""
    return zscored(spark, sf_dir, hours).groupBy("idx", "us").pivot("series", list(TYPES)).agg(F.first("z"))


# Sources, projections, joins -------------------------------------------------------------------------------------------


@query(f"WITH {S1} SELECT series, us, idx, {r6('value')} FROM s1")
def grid_events_hourly(spark, sf_dir):
    return rounded(binned(spark, sf_dir, 1).select("series", "us", "idx", "value"), "value")


@query(f"WITH {S6} SELECT idx, us, {', '.join(f'round(max(CASE WHEN series = {t!r} THEN value END), 6) + 0e0 AS {t}' for t in TYPES)} FROM s6 GROUP BY idx, us")
def pivot_wide(spark, sf_dir):
    return rounded(binned(spark, sf_dir).groupBy("idx", "us").pivot("series", list(TYPES)).agg(F.avg("value")), *TYPES)


@query("SELECT o_orderkey AS id, 'total' AS variable, round(o_totalprice, 6) AS value FROM orders UNION ALL SELECT o_orderkey, 'cust', CAST(o_custkey AS DOUBLE) FROM orders")
def melt_long(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice", 6).alias("total"), F.col("o_custkey").cast("double").alias("cust"))
    return o.unpivot("id", ["total", "cust"], "variable", "value")


@query("""SELECT event_id, CASE WHEN coalesce(nullif(event_id % 4, 3), 2) IN (0, 1) THEN round(value, 6) END AS value,
  CASE WHEN value > 0 THEN round(value / (value + 10e0) * 100, 6) END AS pct FROM events""")
def masked_projection(spark, sf_dir):
    from ..sources.series import quality_masked

    e = load(spark, sf_dir, "events")
    flag = F.nullif(F.col("event_id") % 4, F.lit(3))
    return e.select("event_id", quality_masked(F.round("value", 6), flag).alias("value"), F.when(F.col("value") > 0, F.round(stats.percent_of(F.col("value"), F.col("value") + 10), 6)).alias("pct"))


@query(f"WITH {S6}, p AS (SELECT * FROM (VALUES ('early', 0, 39), ('late', 40, 90)) t(period, a, b)) SELECT period, series, count(*) AS n, round(avg(value), 6) AS mean FROM s6 JOIN p ON idx BETWEEN a AND b GROUP BY ALL")
def period_range_join(spark, sf_dir):
    s = binned(spark, sf_dir)
    p = spark.createDataFrame([("early", 0, 39), ("late", 40, 90)], "period string, start long, end long")
    return attribution.in_periods(s, p, "idx").groupBy("period", "series").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {S6}, a AS (SELECT us, value FROM s6 WHERE series = 'click'), b AS (SELECT us, value FROM s6 WHERE series = 'view' AND idx > 10) SELECT us, round(greatest(a.value, b.value), 6) AS level, b.us IS NULL AS only_a FROM a FULL JOIN b USING (us)")
def outer_level(spark, sf_dir):
    s = binned(spark, sf_dir)
    a, b = s.where("series = 'click'").select("us", F.col("value").alias("va")), s.where("series = 'view' AND idx > 10").select("us", F.col("value").alias("vb"), F.lit(True).alias("has_b"))
    return a.join(b, "us", "full").select("us", F.round(F.greatest("va", "vb"), 6).alias("level"), F.col("has_b").isNull().alias("only_a"))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def semi_anti(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").select("c_custkey")
    large = o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    pending = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(large, "c_custkey", "left_semi").join(pending, "c_custkey", "left_anti")


# Resampling and alignment ----------------------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT event_type AS series, epoch_us(ts) - epoch_us(ts) % {STEP6} AS us, value FROM events), {S6}
SELECT g.series, g.us, round(avg(e.value), 6) AS mean, round(quantile_cont(e.value, 0.5), 6) AS median, count(e.value) AS n FROM s6 g LEFT JOIN e USING (series, us) GROUP BY ALL""")
def resample_6h_stats(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumnRenamed("event_type", "series")
    s = align.resample(e, "ts", 6, [F.avg("value").alias("mean"), stats.half("value").alias("median"), F.count("value").alias("n")], ["series"])
    return rounded(s, "mean", "median").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, round(avg(l_extendedprice), 6) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def resample_daily(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("l_extendedprice"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH e AS (SELECT epoch_us(ts) - epoch_us(ts) % {STEP6} AS us, CASE WHEN event_id % 5 <> 0 THEN event_id % 4 END AS status, value FROM events)
SELECT us, CASE WHEN count(status) > 0 THEN round(count_if(status >= 1) / count(*), 6) END AS cloudy, CASE WHEN count(status) > 0 THEN round(count_if(status = 3) / count(*), 6) END AS obscured,
  round(quantile_cont(CASE WHEN status >= 1 THEN value END, 0.5), 6) AS base FROM e GROUP BY us""")
def cond_fraction_6h(spark, sf_dir):
    e = align.bucket(load(spark, sf_dir, "events"), "ts", 6).withColumn("status", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 4))
    share = lambda c: F.when(F.count("status") > 0, F.round(F.count_if(c) / F.count(F.lit(1)), 6))
    return e.groupBy("us").agg(share(F.col("status") >= 1).alias("cloudy"), share(F.col("status") == 3).alias("obscured"), F.round(stats.half(F.when(F.col("status") >= 1, F.col("value"))), 6).alias("base"))


def _kernel_sql(value: str, result: str, reach: str) -> str:
    return f"""WITH ev AS (SELECT event_type AS series, epoch_us(ts) AS t, {value} AS v FROM events), l AS (SELECT min(t) AS s, max(t) AS e, min(t) - min(t) % {STEP1} AS a FROM ev),
g AS (SELECT series, us FROM (SELECT series, unnest(range(a, e + 1, {STEP6})) AS us, s, e FROM (SELECT DISTINCT series FROM ev) CROSS JOIN l) WHERE us BETWEEN s AND e),
w AS (SELECT g.series, g.us, v, exp(-0.5e0 * power((t - us) / {STEP6 / 4!r}, 2)) AS w FROM g JOIN ev ON g.series = ev.series AND abs(t - us) <= {reach}),
r AS (SELECT series, us, {result} AS value FROM w GROUP BY ALL)
SELECT g.series, g.us, round(r.value, 6) + 0e0 AS value FROM g LEFT JOIN r USING (series, us)"""


def _kernel(spark, sf_dir, kind, value):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", value.alias("v"))
    return rounded(align.kernel_resample(e, "ts", "v", 6, kind, ["series"]).select("series", "us", "value"), "value")


@query(_kernel_sql("value", "sum(w * v) / sum(w)", str(STEP6)))
def gaussian_align(spark, sf_dir):
    return _kernel(spark, sf_dir, "mean", F.col("value"))


@query(_kernel_sql("(value * 3e0) % 360e0", "(degrees(atan2(sum(w * sin(radians(v))), sum(w * cos(radians(v))))) + 360e0) % 360e0", str(STEP6)))
def circular_align(spark, sf_dir):
    return _kernel(spark, sf_dir, "circular", F.pmod(F.col("value") * 3.0, F.lit(360.0)))


@query(_kernel_sql("value", "sum(v)", str(STEP6 // 2)))
def flux_align(spark, sf_dir):
    return _kernel(spark, sf_dir, "flux", F.col("value"))


GAPPY = "gp AS (SELECT series, us, idx, CASE WHEN idx % 11 NOT IN (3, 4) AND idx % 29 <> 7 THEN value END AS value FROM s1)"


def gappy(spark, sf_dir):
    return binned(spark, sf_dir, 1).withColumn("value", F.when(~(F.col("idx") % 11).isin(3, 4) & (F.col("idx") % 29 != 7), F.col("value")))


@query(f"""WITH {S1}, {GAPPY}, f AS (SELECT *, idx - row_number() OVER (PARTITION BY series, value IS NULL ORDER BY idx) AS grp, lag(value) OVER w AS b, lead(value) OVER w AS a, lead(us) OVER w AS nu FROM gp WINDOW w AS (PARTITION BY series ORDER BY idx))
SELECT series, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_missing, (arg_max(nu, idx) - min(us)) / 3.6e9 AS gap_hours FROM f WHERE value IS NULL GROUP BY series, grp HAVING min(idx) > 0 AND max(idx) < (SELECT max(idx) FROM gp)""")
def gap_islands(spark, sf_dir):
    return align.gaps(gappy(spark, sf_dir), ["series"])


def _fill_sql(limit: str) -> str:
    return f"""WITH {S1}, {GAPPY}, f AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0,
  first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS i1 FROM gp
  WINDOW b AS (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, idx, round(CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NOT NULL AND v1 IS NOT NULL AND {limit} THEN v0 + (v1 - v0) * (idx - i0) / (i1 - i0) END, 6) AS filled FROM f"""


@query(_fill_sql("i1 - i0 - 1 <= 2"))
def gap_interpolate(spark, sf_dir):
    return rounded(align.interpolate(gappy(spark, sf_dir), 2.0, ["series"]).select("series", "idx", "filled"), "filled")


@query(_fill_sql("true"))
def display_interpolate(spark, sf_dir):
    return rounded(align.interpolate(gappy(spark, sf_dir), None, ["series"]).select("series", "idx", "filled"), "filled")


@query(f"""WITH v AS (SELECT 'count' AS variable, epoch_us(ts) AS t, CAST(user_id AS DOUBLE) AS v FROM events WHERE event_type = 'click' UNION ALL SELECT 'spend', epoch_us(ts), value FROM events WHERE event_type = 'purchase'),
l AS (SELECT min(t) AS s, max(t) AS e, min(t) - min(t) % {STEP1} AS a FROM v),
g AS (SELECT variable, us FROM (SELECT variable, unnest(range(a, e + 1, {STEP6})) AS us, s, e FROM (SELECT DISTINCT variable FROM v) CROSS JOIN l) WHERE us BETWEEN s AND e),
w AS (SELECT g.variable, us, v, exp(-0.5e0 * power((t - us) / {STEP6 / 4!r}, 2)) AS w FROM g JOIN v ON g.variable = v.variable AND abs(t - us) <= {STEP6})
SELECT g.variable, g.us, round(sum(w * v) / sum(w), 6) AS value FROM g LEFT JOIN w USING (variable, us) GROUP BY ALL""")
def align_merge(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").select("ts", F.col("user_id").cast("double").alias("count"))
    b = e.where("event_type = 'purchase'").select(F.col("ts").alias("at"), F.col("value").alias("spend"))
    return rounded(align.align_datasets([(a, "ts"), (b, "at")], 6).select("variable", "us", "value"), "value")


@query("""WITH d AS (SELECT (epoch_us(d) - lag(epoch_us(d)) OVER (ORDER BY d)) / 3.6e9 AS h FROM (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS d FROM orders))
SELECT quantile_cont(h, 0.5) AS median_hours, 'inferred_' || printf('%.1f', quantile_cont(h, 0.5)) || 'H' AS label, CAST(floor(30 * 24 / quantile_cont(h, 0.5)) AS BIGINT) AS window_points FROM d""")
def freq_detect(spark, sf_dir):
    return align.detect_frequency(load(spark, sf_dir, "orders").select("o_orderdate").distinct(), "o_orderdate")


# Statistics ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {S1}, {GAPPY}, e AS (SELECT series, min(us) AS first_us, max(us) AS last_us FROM gp WHERE value IS NOT NULL GROUP BY series),
f AS (SELECT gp.*, idx - row_number() OVER (PARTITION BY series, value IS NULL ORDER BY idx) AS grp FROM gp),
g AS (SELECT series, grp, count(*) AS len FROM f JOIN e USING (series) WHERE value IS NULL AND us > first_us AND us < last_us GROUP BY ALL),
n AS (SELECT series, count(*) AS n_grid, count(value) AS n_valid FROM gp GROUP BY series), gg AS (SELECT series, count(*) AS n_gaps, max(len) AS longest_gap FROM g GROUP BY series)
SELECT series, n_grid, n_valid, first_us, last_us, coalesce(n_gaps, 0) AS n_gaps, coalesce(longest_gap, 0) AS longest_gap, round(n_valid / n_grid * 100, 6) AS pct FROM n LEFT JOIN e USING (series) LEFT JOIN gg USING (series)""")
def coverage(spark, sf_dir):
    return rounded(stats.coverage(gappy(spark, sf_dir), ["series"]), "pct")


@query("SELECT l_returnflag AS flag, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) GROUP BY ALL")
def describe(spark, sf_dir):
    d = stats.describe(load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), ["flag"], "l_extendedprice")
    return rounded(d, "mean", "std", "median", "q1", "q3", "iqr")


@query(f"WITH {S1}, r AS (SELECT series, us, value, row_number() OVER (PARTITION BY series ORDER BY value, us) AS lo, row_number() OVER (PARTITION BY series ORDER BY value DESC, us) AS hi FROM s1 WHERE value IS NOT NULL) SELECT series, us, round(value, 6) AS value, lo AS rank, 'low' AS side FROM r WHERE lo <= 8 UNION ALL SELECT series, us, round(value, 6), hi, 'high' FROM r WHERE hi <= 8")
def extremes_topk(spark, sf_dir):
    return rounded(stats.extremes(binned(spark, sf_dir, 1), ["series"], 8).select("series", "us", "value", "rank", "side"), "value")


@query(f"WITH {Z6} SELECT series, idx, {r6('z')} FROM z6")
def robust_zscore(spark, sf_dir):
    return rounded(zscored(spark, sf_dir).select("series", "idx", "z"), "z")


@query(f"""WITH {S6}, d AS (SELECT series, idx, sin(radians((value * 3e0) % 360e0)) AS s, cos(radians((value * 3e0) % 360e0)) AS c FROM s6 WHERE value IS NOT NULL),
m AS (SELECT series, quantile_cont(s, 0.5) AS ms, quantile_cont(c, 0.5) AS mc FROM d GROUP BY series), o AS (SELECT series, idx, s - ms AS s, c - mc AS c FROM d JOIN m USING (series)),
p AS (SELECT series, quantile_cont(abs(x), 0.5) AS mad FROM (SELECT series, s AS x FROM o UNION ALL SELECT series, c FROM o) GROUP BY series)
SELECT series, idx, round(0.6745e0 * s / mad, 6) + 0e0 AS sin, round(0.6745e0 * c / mad, 6) + 0e0 AS cos FROM o JOIN p USING (series)""")
def circular_encode(spark, sf_dir):
    d = binned(spark, sf_dir).where("value IS NOT NULL").withColumn("value", F.pmod(F.col("value") * 3.0, F.lit(360.0)))
    return rounded(normalize.circular_components(d, "value", ["series"]).select("series", "idx", "sin", "cos"), "sin", "cos")


@query(f"WITH {S1} SELECT series, idx, round(CASE WHEN count(value) OVER w >= 16 THEN quantile_cont(value, 0.5) OVER w END, 6) AS baseline, round(greatest(0e0, value - CASE WHEN count(value) OVER w >= 16 THEN quantile_cont(value, 0.5) OVER w END), 6) AS excess FROM s1 WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 24 PRECEDING AND 23 FOLLOWING)")
def baseline_excess(spark, sf_dir):
    d = attribution.layers(binned(spark, sf_dir, 1), 48, entity="series")
    return rounded(d.select("series", "idx", "baseline", F.when(F.col("value").isNull() & F.col("baseline").isNull(), F.lit(0.0)).otherwise(F.col("excess")).alias("excess")), "baseline", "excess")


@query(f"WITH {S1} SELECT series, idx, round(avg(value) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM s1")
def rolling_mean_center(spark, sf_dir):
    return rounded(stats.rolling_mean(binned(spark, sf_dir, 1), ["series"], 8).select("series", "idx", "smooth"), "smooth")


@query(f"""WITH {S6}, r AS (SELECT series, us, value, greatest(value, 0) AS c, row_number() OVER (PARTITION BY series ORDER BY greatest(value, 0)) AS i FROM s6 WHERE value IS NOT NULL)
SELECT series, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(max(value), 6) AS peak, min(us) FILTER (value = (SELECT max(value) FROM r q WHERE q.series = r.series)) AS peak_at,
  round(stddev_pop(value), 6) AS std, round(stddev_pop(value) / avg(value), 6) AS cv, round(2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY series""")
def series_stats(spark, sf_dir):
    return rounded(stats.series_stats(binned(spark, sf_dir), ["series"]), "total", "mean", "peak", "std", "cv", "gini")


def _pair_sql() -> str:
    return f"{S6}, pr AS (SELECT a.idx, a.us, a.value AS a, b.value AS b FROM s6 a JOIN s6 b USING (idx) WHERE a.series = 'click' AND b.series = 'view' AND a.value IS NOT NULL AND b.value IS NOT NULL)"


def pair(spark, sf_dir):
    s = binned(spark, sf_dir)
    return s.where("series = 'click'").select("idx", "us", F.col("value").alias("a")).join(s.where("series = 'view'").select("idx", F.col("value").alias("b")), "idx").dropna()


@query(f"WITH {_pair_sql()} SELECT count(*) AS n, round(corr(a, b), 6) AS r, round(avg(b - a), 6) AS bias, round(sqrt(avg((b - a) * (b - a))), 6) AS rmse FROM pr")
def agreement(spark, sf_dir):
    return rounded(stats.agreement(pair(spark, sf_dir), "a", "b"), "r", "bias", "rmse")


@query(f"""WITH {_pair_sql()}, q AS (SELECT round(a / 50) AS a, round(b / 50) AS b FROM pr), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM q),
j AS (SELECT a >= quantile_cont(a, 0.9) OVER () AS ta, b >= quantile_cont(b, 0.9) OVER () AS tb FROM pr)
SELECT (SELECT round(corr(ra, rb), 6) FROM k) AS rho, (SELECT round(count_if(ta AND tb) / count_if(ta OR tb), 6) FROM j) AS jaccard""")
def rank_agreement(spark, sf_dir):
    p = pair(spark, sf_dir)
    coarse = p.select(F.round(F.col("a") / 50).alias("a"), F.round(F.col("b") / 50).alias("b"))
    # One row each.
    return rounded(stats.spearman(coarse, "a", "b").join(F.broadcast(stats.top_jaccard(p, "a", "b", 0.9))), "rho", "jaccard")


@query(f"WITH {S6}, k AS (SELECT a + 60 * {STEP6} AS c FROM s6_l) SELECT series, round(avg(value) FILTER (us < c), 6) AS before, round(avg(value) FILTER (us >= c), 6) AS after, round(avg(value) FILTER (us < c AND c - us <= 432000000000), 6) AS before_near, round(avg(value) FILTER (us >= c AND us - c <= 432000000000), 6) AS after_near FROM s6 CROSS JOIN k GROUP BY series")
def step_means(spark, sf_dir):
    s = binned(spark, sf_dir)
    c = s.agg(F.min("us")).first()[0] + 60 * STEP6
    return rounded(stats.step_means(s, ["series"], c, 5), "before", "after", "before_near", "after_near")


def _episode_sql(source: str, gap: int, least: int) -> str:
    return f"""m AS (SELECT series, quantile_cont(value, 0.5) AS med FROM {source} GROUP BY series), d AS (SELECT series, quantile_cont(abs(value - med), 0.5) AS mad FROM {source} JOIN m USING (series) GROUP BY series),
a0 AS (SELECT series, idx, value, coalesce(value > med + 1.4826e0 * mad, false) AS on0 FROM {source} JOIN m USING (series) JOIN d USING (series)),
a1 AS (SELECT *, idx - row_number() OVER (PARTITION BY series, on0 ORDER BY idx) AS g0 FROM a0), a2 AS (SELECT *, count(*) OVER (PARTITION BY series, on0, g0) AS len, min(idx) OVER (PARTITION BY series, on0, g0) AS lo, max(idx) OVER (PARTITION BY series, on0, g0) AS hi, max(idx) OVER (PARTITION BY series) AS top FROM a1),
a3 AS (SELECT series, idx, value, on0 OR (len <= {gap} AND lo > 0 AND hi < top) AS on1 FROM a2), a4 AS (SELECT *, idx - row_number() OVER (PARTITION BY series, on1 ORDER BY idx) AS g1 FROM a3),
ep AS (SELECT series, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_windows, max(value) AS peak_value, arg_max(idx, value) AS peak_idx FROM a4 WHERE on1 GROUP BY series, g1 HAVING count(*) >= {least})"""


EPISODE_SQL = f"{S6}, {_episode_sql('s6', 2, 3)}"


@query(f"WITH {EPISODE_SQL} SELECT series, first_idx, last_idx, n_windows, round(peak_value, 6) AS peak_value, peak_idx FROM ep")
def detect_episodes(spark, sf_dir):
    rows = stats.episode_rows(binned(spark, sf_dir), ["series"], 1.0, 3, 2)
    return rounded(stats.episodes(rows, ["series"]), "peak_value")


@query(f"WITH {EPISODE_SQL}, i AS (SELECT s.series, s.value, EXISTS (SELECT 1 FROM ep WHERE ep.series = s.series AND s.idx BETWEEN first_idx AND last_idx) AS on2 FROM s6 s) SELECT series, round(avg(value) FILTER (on2) / avg(value) FILTER (NOT on2), 6) AS alignment FROM i GROUP BY series")
def episode_alignment(spark, sf_dir):
    return rounded(stats.episode_alignment(stats.episode_rows(binned(spark, sf_dir), ["series"], 1.0, 3, 2), ["series"]), "alignment")


# Discrete estimators ---------------------------------------------------------------------------------------------------


def _h(columns: str) -> str:
    return f"(SELECT sum(-n / t * ln(n / t)) / ln(2) FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t FROM lineitem GROUP BY {columns}))"


def _line(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"), F.col("l_linenumber").alias("z"))


@query(f"SELECT round({_h('l_returnflag')}, 6) AS h, round({_h('l_returnflag, l_linestatus')} - {_h('l_linestatus')}, 6) AS h_given, round({_h('l_returnflag')} + {_h('l_linestatus')} - {_h('l_returnflag, l_linestatus')}, 6) AS mi")
def discrete_entropy(spark, sf_dir):
    d = _line(spark, sf_dir)
    return rounded(discrete.entropy(d, ["x"]).join(discrete.conditional_entropy(d, ["x"], ["y"]).withColumnRenamed("h", "h_given")).join(discrete.mutual_information(d, ["x"], ["y"])), "h", "h_given", "mi")


@query(f"SELECT round({_h('l_returnflag, l_linenumber')} + {_h('l_linestatus, l_linenumber')} - {_h('l_returnflag, l_linestatus, l_linenumber')} - {_h('l_linenumber')}, 6) AS cmi")
def discrete_cmi(spark, sf_dir):
    return rounded(discrete.conditional_mutual_information(_line(spark, sf_dir), ["x"], ["y"], ["z"]), "cmi")


_TC = f"({_h('l_returnflag')} + {_h('l_linestatus')} - {_h('l_returnflag, l_linestatus')})"
_CTC = f"({_h('l_returnflag, l_linenumber')} + {_h('l_linestatus, l_linenumber')} - {_h('l_returnflag, l_linestatus, l_linenumber')} - {_h('l_linenumber')})"


@query(f"SELECT round({_TC}, 6) AS tc, round({_CTC}, 6) AS ctc, round({_TC} - {_CTC}, 6) + 0e0 AS corex")
def discrete_correlations(spark, sf_dir):
    d = _line(spark, sf_dir)
    return rounded(discrete.total_correlation(d, ["x", "y"]).join(discrete.conditional_total_correlation(d, ["x", "y"], ["z"])).join(discrete.explained_correlation(d, ["x", "y"], ["z"])), "tc", "ctc", "corex")


# Rolling information ---------------------------------------------------------------------------------------------------

PAIRS = list(permutations(TYPES, 2))


def _window_rows(entities: list[tuple[str, list[str], str]]) -> str:
    """Rows of every window for entities (name, sources, target) over z6."""
    parts = []
    for name, sources, target in entities:
        xs = ", ".join(f"x{i}.z AS x{i + 1}" for i in range(len(sources)))
        joins = " ".join(f"JOIN z6 x{i} ON x{i}.idx = y.idx AND x{i}.series = '{s}'" for i, s in enumerate(sources))
        parts.append(f"SELECT '{name}' AS entity, c.idx - {HALF} AS window_idx, y.idx, {xs}, y.z AS y FROM z6 c JOIN z6 y ON y.series = '{target}' AND y.idx >= c.idx - {HALF} AND y.idx < c.idx + {HALF} {joins} WHERE c.series = 'click' AND c.idx >= {HALF} AND c.idx <= (SELECT max(idx) FROM z6) - {HALF}")
    return " UNION ALL ".join(parts)


def _over_z6(sql: str) -> str:
    """The estimator's SQL with the z-scored series in front."""
    return f"WITH {Z6}, " + sql.strip().removeprefix("WITH ")


def _te_oracle(entities, taus, history=1, tail="SELECT entity, window_idx, round(te_raw, 6) + 0e0 AS te_raw, round(greatest(te_raw, 0), 6) + 0e0 AS te_bits FROM (", end=")"):
    return f"{tail}{_over_z6(knn_sql.te_sql(_window_rows(entities), taus, history))}{end}"


def _te(spark, sf_dir, entities, named: dict[str, str]):
    te = rolling.rolling_te(wide(spark, sf_dir), entities, 2 * HALF)
    name = F.concat_ws("", "entity", F.lit(" > "), "target")
    return te.select(name.alias("entity"), "window_idx", "history", "te_raw", "te_bits")


def _name(sources, taus, target):
    return "+".join(f"{s}__t{t}" for s, t in zip(sources, taus)) + " > " + target


@query(_te_oracle([(_name([a], [1], b), [a], b) for a, b in PAIRS], [1]))
def rolling_te(spark, sf_dir):
    te = _te(spark, sf_dir, [catalog.Entity(b, ((a, 1),)) for a, b in PAIRS], {})
    return rounded(te.drop("history"), "te_raw", "te_bits")


JOINT = [(("click", "view"), "purchase"), (("error", "signup"), "view")]


@query(_te_oracle([(_name(s, [1, 2], t), list(s), t) for s, t in JOINT], [1, 2]))
def rolling_jte(spark, sf_dir):
    te = _te(spark, sf_dir, [catalog.Entity(t, tuple(zip(s, (1, 2)))) for s, t in JOINT], {})
    return rounded(te.drop("history"), "te_raw", "te_bits")


#: Seven pairs, as many as the published sweep has.
SWEPT = PAIRS[:7]


@query(" UNION ALL ".join(f"SELECT *, {h} AS history FROM ({_te_oracle([(_name([a], [1], b), [a], b) for a, b in SWEPT], [1], h)})" for h in (0, 1, 2, 3, 4)))
def history_sweep(spark, sf_dir):
    te = _te(spark, sf_dir, [catalog.Entity(b, ((a, 1),), h) for h in (0, 1, 2, 3, 4) for a, b in SWEPT], {})
    return rounded(te, "te_raw", "te_bits")


@query(_te_oracle([(_name(["click"], [0], "error"), ["click"], "error")], [0]))
def te_lag_zero(spark, sf_dir):
    return rounded(_te(spark, sf_dir, [catalog.Entity("error", (("click", 0),))], {}).drop("history"), "te_raw", "te_bits")


_VECTOR = [("wind__t1 > purchase", ["click", "view"], "purchase")]


@query(_te_oracle(_VECTOR, [1, 1]))
def te_vector_source(spark, sf_dir):
    te = rolling.rolling_te(wide(spark, sf_dir), [catalog.Entity("purchase", (("wind", 1),))], 2 * HALF, vector_bases={"wind": ["click", "view"]})
    return rounded(te.select(F.lit("wind__t1 > purchase").alias("entity"), "window_idx", "te_raw", "te_bits"), "te_raw", "te_bits")


@query(_te_oracle([(_name(["click"], [1], "purchase"), ["click"], "purchase")], [1], tail="SELECT entity, window_idx, round(te_raw, 6) + 0e0 AS te_raw FROM ("))
def te_relational(spark, sf_dir):
    z = zscored(spark, sf_dir)
    z.createOrReplaceTempView("z6")
    sql = knn_sql.te_sql(_window_rows([(_name(["click"], [1], "purchase"), ["click"], "purchase")]), [1])
    return rounded(spark.sql(sql), "te_raw")


def _entropy_rows() -> str:
    return f"SELECT c.series AS entity, c.idx - {HALF} AS window_idx, y.idx, y.z AS x1 FROM z6 c JOIN z6 y ON y.series = c.series AND y.idx >= c.idx - {HALF} AND y.idx < c.idx + {HALF} WHERE c.idx >= {HALF} AND c.idx <= (SELECT max(idx) FROM z6) - {HALF}"


@query(f"SELECT entity AS target, window_idx, round(greatest(h_raw, 0), 6) + 0e0 AS h_bits FROM ({_over_z6(knn_sql.entropy_sql(_entropy_rows()))})")
def rolling_entropy(spark, sf_dir):
    return rounded(rolling.rolling_entropy(wide(spark, sf_dir), TYPES, 2 * HALF).select("target", "window_idx", "h_bits"), "h_bits")


@query(f"""WITH t AS ({_te_oracle([(_name(['click'], [1], 'view'), ['click'], 'view')], [1])}), h AS (SELECT window_idx, greatest(h_raw, 0) AS h FROM ({_over_z6(knn_sql.entropy_sql(_entropy_rows()))}) WHERE entity = 'view')
SELECT window_idx, round(CASE WHEN h > 0 THEN te_bits / h * 100 END, 4) AS pct_h FROM t LEFT JOIN h USING (window_idx)""")
def normalised_te(spark, sf_dir):
    w = wide(spark, sf_dir)
    te = rolling.rolling_te(w, [catalog.Entity("view", (("click", 1),))], 2 * HALF)
    h = rolling.rolling_entropy(w, ["view"], 2 * HALF)
    return te.join(h, ["target", "window_idx"], "left").select("window_idx", F.round(stats.percent_of(F.round("te_bits", 6), F.col("h_bits")), 4).alias("pct_h"))


# Surrogates and significance ---------------------------------------------------------------------------------------------

REPLICATES = f"""rp AS (SELECT event_type AS entity, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // {24 * STEP1} AS window_idx, value AS te_bits FROM events),
ob AS (SELECT entity, window_idx, avg(te_bits) * 1.5e0 AS observed FROM rp GROUP BY ALL)"""


@query(f"""WITH {REPLICATES} SELECT entity, window_idx, round(observed, 6) AS te_bits, count(*) AS n_valid, round(avg(te_bits), 6) AS surr_mean, round(stddev_pop(te_bits), 6) AS surr_std, round(quantile_cont(te_bits, 0.95), 6) AS surr_p95, round(quantile_cont(te_bits, 0.99), 6) AS surr_p99,
  round(quantile_cont(te_bits, 0.025), 6) AS lower_ci, round(quantile_cont(te_bits, 0.975), 6) AS upper_ci, round(avg((te_bits >= observed)::DOUBLE), 6) AS p_value, observed > quantile_cont(te_bits, 0.95) AS sig95, observed > quantile_cont(te_bits, 0.99) AS sig99 FROM rp JOIN ob USING (entity, window_idx) GROUP BY entity, window_idx, observed""")
def significance_of_replicates(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    first = e.agg(F.min(align.micros(F.col("ts"))).alias("a"))
    r = e.join(F.broadcast(first)).select(F.col("event_type").alias("entity"), F.expr(f"(unix_micros(cast(ts as timestamp)) - a) div {24 * STEP1}").alias("window_idx"), F.col("value").alias("te_bits"))
    observed = r.groupBy("entity", "window_idx").agg((F.avg("te_bits") * 1.5).alias("te_bits")).withColumn("us", F.lit(0))
    s = rolling.significance(observed, r, ["entity", "window_idx"]).drop("us")
    return rounded(s, "te_bits", "surr_mean", "surr_std", "surr_p95", "surr_p99", "lower_ci", "upper_ci", "p_value")


#: Surrogates of the significance queries, the engine's default.
SURROGATES = 100


def _significant(spark, sf_dir, kind):
    w, e = wide(spark, sf_dir), [catalog.Entity("view", (("click", 1),)), catalog.Entity("purchase", (("click", 1), ("view", 0)))]
    return rolling.significance(rolling.rolling_te(w, e, 2 * HALF), rolling.surrogate_te(w, e, 2 * HALF, SURROGATES, kind))


@query()
def iaaft_significance(spark, sf_dir):
    return _significant(spark, sf_dir, "iaaft")


@query()
def shuffle_significance(spark, sf_dir):
    return _significant(spark, sf_dir, "shuffle")


@query()
def block_significance(spark, sf_dir):
    return _significant(spark, sf_dir, "block")


@query()
def phase_significance(spark, sf_dir):
    return _significant(spark, sf_dir, "phase")


@query()
def family_level(spark, sf_dir):
    return rolling.family_level(_significant(spark, sf_dir, "shuffle"))


# Combinations and attribution --------------------------------------------------------------------------------------------


def event_candidates(spark, sf_dir):
    """Candidates of each event type from the events: types with short names at lags 0 to 2, others at 0 and 4; a target leaves out the types that begin as it does."""
    types = load(spark, sf_dir, "events").select(F.col("event_type").alias("base")).distinct().withColumn("grp", F.when(F.length("base") <= 5, "short").otherwise("long"))
    lags = types.select("grp", F.explode(F.when(F.col("grp") == "short", F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(F.lit(0), F.lit(4)))).alias("tau"))
    targets = types.select(F.col("base").alias("target"))
    excluded = targets.join(types, F.substring("target", 1, 1) == F.substring("base", 1, 1)).select("target", "base")
    return catalog.candidates_of(types, lags, targets, excluded)


CANDIDATES = """ty AS (SELECT DISTINCT event_type AS base, CASE WHEN length(event_type) <= 5 THEN 'short' ELSE 'long' END AS grp FROM events),
ca AS (SELECT t.base AS target, c.grp, c.base, tau, c.base || '__t' || tau AS name FROM ty t JOIN ty c ON left(t.base, 1) <> left(c.base, 1) CROSS JOIN (SELECT unnest([0, 1, 2, 4]) AS tau) WHERE tau IN (0, CASE WHEN c.grp = 'short' THEN 1 ELSE 4 END, CASE WHEN c.grp = 'short' THEN 2 ELSE 4 END)),
cp AS (SELECT a.target, a.name || '+' || b.name AS entity, 2 AS n_bases, list_sort([a.base, b.base]) AS bases, b.name AS last FROM ca a JOIN ca b ON a.target = b.target AND a.name < b.name AND a.base <> b.base),
cq AS (SELECT cp.target, entity || '+' || ca.name AS entity, 3 AS n_bases, list_sort(list_append(bases, ca.base)) AS bases FROM cp JOIN ca ON ca.target = cp.target AND last < ca.name AND NOT list_contains(bases, ca.base))"""


@query(f"WITH {CANDIDATES} SELECT target, grp, base, CAST(tau AS INTEGER) AS tau, name FROM ca")
def candidates(spark, sf_dir):
    return event_candidates(spark, sf_dir)


@query(f"WITH {CANDIDATES} SELECT target, entity, CAST(n_bases AS BIGINT) AS n_bases, array_to_string(bases, ';') AS bases FROM cp UNION ALL SELECT target, entity, n_bases, array_to_string(bases, ';') FROM cq")
def combinations(spark, sf_dir):
    c = catalog.combinations(event_candidates(spark, sf_dir), keys=["target"])
    return c.select("target", "entity", "n_bases", F.array_join("bases", ";").alias("bases"))


_PART = "list_transform(string_split(entity, '+'), lambda p: regexp_extract(p, '^(.*)__t([0-9]+)$', {}))"


@query(f"""WITH {CANDIDATES}, e AS (SELECT DISTINCT name AS entity FROM ca UNION SELECT entity FROM cp UNION SELECT entity FROM cq), p AS (SELECT entity, {_PART.format(1)} AS b, {_PART.format(2)} AS t FROM e)
SELECT entity, CASE len(b) WHEN 1 THEN 'single' WHEN 2 THEN 'pair' ELSE 'triple' END AS kind, len(b) AS n_bases, array_to_string(b, ';') AS bases, array_to_string(t, ';') AS taus, array_to_string(list_transform(list_zip(b, t), lambda z: z[1] || ' (lag ' || z[2] || ')'), ' + ') AS label FROM p""")
def entity_catalog(spark, sf_dir):
    c = event_candidates(spark, sf_dir)
    return catalog.described(c.select(F.col("name").alias("entity")).unionByName(catalog.combinations(c, keys=["target"]).select("entity")).distinct())


def facts(spark, sf_dir):
    """Stand-in sweep results: a joint value for each pair of types in each 6-hour window."""
    s = binned(spark, sf_dir).select("series", "us", "idx", (F.coalesce("value", F.lit(0.0)) / 1013).alias("v"))
    a, b = s.select("us", "idx", F.col("series").alias("a"), F.col("v").alias("va")), s.select("idx", F.col("series").alias("b"), F.col("v").alias("vb"))
    p = a.join(b, "idx").where("a < b").withColumns({"sum_te": F.col("va") + F.col("vb"), "max_te": F.greatest("va", "vb"), "window_idx": F.col("idx")})
    p = p.withColumn("jte_bits", F.col("sum_te") * (F.lit(0.33) + F.lit(0.1) * ((F.col("idx") + F.length("a") * F.length("b")) % 9)))
    return attribution.categorised(p.withColumn("entity", F.concat("a", F.lit("__t0+"), "b", F.lit("__t1"))))


FACTS = f"""{S6}, v6 AS (SELECT series, us, idx, coalesce(value, 0) / 1013 AS v FROM s6), f0 AS (SELECT a.series || '__t0+' || b.series || '__t1' AS entity, a.us, a.idx, a.v + b.v AS sum_te, greatest(a.v, b.v) AS max_te, (a.v + b.v) * (0.33e0 + 0.1e0 * ((a.idx + length(a.series) * length(b.series)) % 9)) AS jte_bits FROM v6 a JOIN v6 b ON a.idx = b.idx AND a.series < b.series),
f1 AS (SELECT *, CASE WHEN jte_bits > sum_te THEN 'synergistic' WHEN jte_bits < max_te THEN 'obfuscating' ELSE 'redundant' END AS category FROM f0), facts AS (SELECT *, CASE WHEN category = 'obfuscating' THEN max_te ELSE jte_bits END AS plotted_value FROM f1),
won AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY idx ORDER BY plotted_value DESC, entity) = 1)"""


@query(f"WITH {FACTS} SELECT entity, idx, category, {r6('plotted_value')} FROM facts")
def interaction_category(spark, sf_dir):
    return rounded(facts(spark, sf_dir).select("entity", "idx", "category", "plotted_value"), "plotted_value")


@query(f"WITH {FACTS} SELECT idx, entity, {r6('plotted_value')} FROM won")
def composite_winner(spark, sf_dir):
    return rounded(attribution.winners(facts(spark, sf_dir), ["idx"]).select("idx", "entity", "plotted_value"), "plotted_value")


@query(f"WITH {FACTS} SELECT entity, count(*) AS wins, round(count(*) / (SELECT count(DISTINCT idx) FROM won), 6) AS win_share FROM won GROUP BY entity")
def win_shares(spark, sf_dir):
    return rounded(attribution.win_shares(attribution.winners(facts(spark, sf_dir), ["idx"])), "win_share")


@query(f"WITH {FACTS}, l AS (SELECT *, lag(category) OVER (PARTITION BY entity ORDER BY idx) AS p FROM facts) SELECT entity, round(avg((category = 'synergistic')::DOUBLE), 6) AS frac_synergistic, round(avg((category = 'redundant')::DOUBLE), 6) AS frac_redundant, round(avg((category = 'obfuscating')::DOUBLE), 6) AS frac_obfuscating, CAST(count_if(category <> p) AS BIGINT) AS n_flips FROM l GROUP BY entity")
def category_fractions(spark, sf_dir):
    c = stats.category_fractions(facts(spark, sf_dir), ["entity"], "category", attribution.CATEGORIES)
    return rounded(c, *[f"frac_{n}" for n in attribution.CATEGORIES])


@query(f"WITH {FACTS} SELECT entity, round(avg(jte_bits), 6) AS mean_jte, round(avg(sum_te), 6) AS mean_sum_te, round(avg(jte_bits - sum_te), 6) AS mean_synergy, round(avg(jte_bits - sum_te) / avg(jte_bits), 6) AS synergy_fraction, round(avg((jte_bits > sum_te)::DOUBLE) * 100, 6) AS pct_synergistic, round(avg((jte_bits < sum_te)::DOUBLE) * 100, 6) AS pct_redundant, round(avg(jte_bits - max_te), 6) AS gain FROM facts GROUP BY entity")
def synergy_stats(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("synergy", F.col("jte_bits") - F.col("sum_te"))
    s = rolling.synergy_stats(f, ["entity"]).join(attribution.synergy_gain(f), "entity")
    return rounded(s, "mean_jte", "mean_sum_te", "mean_synergy", "synergy_fraction", "pct_synergistic", "pct_redundant", "gain")


def _combo_table(spark, sf_dir):
    f = scratch.materialize(facts(spark, sf_dir), "facts")
    won = attribution.winners(f, ["window_idx"])
    active = stats.episode_rows(attribution.envelope(f, ["window_idx"]), [], 1.0, 3, 8, order="window_idx").select("window_idx", "active")
    return attribution.combo_table(f, active, won)


#: cs: a row a combination, unrounded.
COMBOS = f"""{FACTS}, env AS (SELECT 'all' AS series, idx, max(plotted_value) AS value FROM facts GROUP BY idx), {_episode_sql('env', 8, 3)},
act AS (SELECT idx, EXISTS (SELECT 1 FROM ep WHERE env.idx BETWEEN first_idx AND last_idx) AS active FROM env),
rk AS (SELECT entity, idx, plotted_value AS value, greatest(plotted_value, 0) AS c, row_number() OVER (PARTITION BY entity ORDER BY greatest(plotted_value, 0)) AS i FROM facts),
ss AS (SELECT entity, count(*) AS n, sum(value) AS total, avg(value) AS mean, max(value) AS peak, min(idx) FILTER (value = (SELECT max(value) FROM rk q WHERE q.entity = rk.entity)) AS peak_at, stddev_pop(value) AS std, stddev_pop(value) / avg(value) AS cv, 2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1) / count(*) AS gini FROM rk GROUP BY entity),
cf AS (SELECT entity, avg((category = 'synergistic')::DOUBLE) AS frac_synergistic, avg((category = 'redundant')::DOUBLE) AS frac_redundant, avg((category = 'obfuscating')::DOUBLE) AS frac_obfuscating, CAST(count_if(category <> p) AS BIGINT) AS n_flips, avg(jte_bits - max_te) AS gain,
  avg(plotted_value) FILTER (active) / avg(plotted_value) FILTER (NOT active) AS alignment FROM (SELECT *, lag(category) OVER (PARTITION BY entity ORDER BY idx) AS p FROM facts JOIN act USING (idx)) GROUP BY entity),
ws AS (SELECT entity, count(*) AS wins, count(*) / (SELECT count(DISTINCT idx) FROM won) AS win_share FROM won GROUP BY entity),
cs AS (SELECT ss.*, cf.* EXCLUDE (entity), coalesce(wins, 0) AS wins, coalesce(win_share, 0) AS win_share FROM ss JOIN cf USING (entity) LEFT JOIN ws USING (entity))"""
_COMBO_VALUES = ("total", "mean", "peak", "std", "cv", "gini", "frac_synergistic", "frac_redundant", "frac_obfuscating", "win_share", "gain", "alignment")


@query(f"WITH {COMBOS} SELECT entity, n, peak_at, n_flips, wins, {r6(*_COMBO_VALUES)} FROM cs")
def combo_stats(spark, sf_dir):
    return rounded(_combo_table(spark, sf_dir), *_COMBO_VALUES)


_LENS = " UNION ALL ".join(f"(SELECT entity, '{reason}' AS reason FROM st WHERE {column} IS NOT NULL ORDER BY {column} DESC, entity LIMIT 3)" for reason, column in attribution.LENSES.items())


@query(f"WITH {COMBOS}, st AS (SELECT * FROM cs WHERE peak >= (SELECT quantile_cont(peak, 0.5) FROM cs)) SELECT entity, string_agg(reason, ',' ORDER BY reason) AS reasons FROM ({_LENS}) GROUP BY entity")
def shortlist(spark, sf_dir):
    return attribution.shortlist(_combo_table(spark, sf_dir), 3)


def _layers(spark, sf_dir):
    f = facts(spark, sf_dir).select("entity", "us", "idx", (F.col("plotted_value") * 10).alias("value"))
    return attribution.burst_mask(attribution.layers(f, 24).withColumn("floor_pct", F.lit(0.12) + F.lit(0.001) * F.col("idx")), 3, 2)


LAYERS = f"""{FACTS}, y0 AS (SELECT entity, us, idx, plotted_value * 10 AS value FROM facts), y1 AS (SELECT *, CASE WHEN count(value) OVER w >= 8 THEN quantile_cont(value, 0.5) OVER w END AS baseline, 0.12e0 + 0.001e0 * idx AS floor_pct FROM y0 WINDOW w AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)),
y2 AS (SELECT *, greatest(0e0, value - baseline) AS excess, greatest(0e0, value - baseline) > 0 AND value >= floor_pct AS on0 FROM y1), y3 AS (SELECT *, idx - row_number() OVER (PARTITION BY entity, on0 ORDER BY idx) AS g0 FROM y2),
y4 AS (SELECT *, count(*) OVER (PARTITION BY entity, on0, g0) AS len, min(idx) OVER (PARTITION BY entity, on0, g0) AS lo, max(idx) OVER (PARTITION BY entity, on0, g0) AS hi, max(idx) OVER (PARTITION BY entity) AS top FROM y3),
y5 AS (SELECT *, on0 OR (len <= 2 AND lo > 0 AND hi < top) AS on1 FROM y4), y6 AS (SELECT *, idx - row_number() OVER (PARTITION BY entity, on1 ORDER BY idx) AS g1 FROM y5),
ly AS (SELECT *, on1 AND count(*) OVER (PARTITION BY entity, on1, g1) >= 3 AS active FROM y6), pd AS (SELECT * FROM (VALUES ('p1', 0, 49), ('p2', 50, 200)) t(period, a, b)), yp AS (SELECT * FROM ly JOIN pd ON idx BETWEEN a AND b)"""


def _periods(spark):
    return spark.createDataFrame([("p1", 0, 49), ("p2", 50, 200)], "period string, start long, end long")


@query(f"WITH {LAYERS} SELECT entity, idx, {r6('baseline', 'excess')}, active FROM ly")
def burst_mask(spark, sf_dir):
    return rounded(_layers(spark, sf_dir).select("entity", "idx", "baseline", "excess", "active"), "baseline", "excess")


def _by_idx(d):
    return d.withColumn("us", F.col("idx"))


@query(f"WITH {LAYERS} SELECT period, entity, round(avg(value), 3) AS mean_pct, round(avg(baseline), 3) AS baseline_pct, round(sum(CASE WHEN active THEN excess ELSE 0 END), 3) AS burst_pct FROM yp GROUP BY ALL")
def audit_table(spark, sf_dir):
    return attribution.audit(_by_idx(_layers(spark, sf_dir)), _periods(spark))


@query(f"WITH {LAYERS}, e AS (SELECT period, entity, sum(excess) AS integrated, count(*) AS windows, max(value) AS peak, min(idx) FILTER (value = m) AS peak_us FROM (SELECT *, max(value) OVER (PARTITION BY period, entity) AS m FROM yp WHERE active) GROUP BY ALL) SELECT period, entity, {r6('integrated')}, windows, {r6('peak')}, peak_us FROM e WHERE integrated > 0 QUALIFY row_number() OVER (PARTITION BY period ORDER BY integrated DESC, entity) = 1")
def episodic_slot(spark, sf_dir):
    return rounded(attribution.episodic_slot(_by_idx(_layers(spark, sf_dir)), _periods(spark)), "integrated", "peak")


@query(f"WITH {LAYERS}, s AS (SELECT period, entity, avg(value) AS score FROM yp GROUP BY ALL), f AS (SELECT period, avg(floor_pct) AS floor FROM (SELECT DISTINCT period, idx, floor_pct FROM yp) GROUP BY period) SELECT period, entity, {r6('score', 'floor')} FROM s JOIN f USING (period)")
def period_scores(spark, sf_dir):
    return rounded(attribution.period_scores(_by_idx(_layers(spark, sf_dir)), _periods(spark)).select("period", "entity", "score", "floor"), "score", "floor")


def _scores(spark, sf_dir):
    """Scores of the pairs and of their first series alone, at half their value."""
    d = scratch.materialize(_by_idx(_layers(spark, sf_dir)), "layers")
    single = F.regexp_extract("entity", r"^([^+]*)", 1)
    return attribution.period_scores(d.unionByName(d.withColumns({"entity": single, "value": F.col("value") * 0.5})), _periods(spark))


#: sc: period, entity, bases, score, floor, gain over the best proper subset of the bases.
SCORES = f"""{LAYERS}, yb AS (SELECT period, entity, idx, value FROM yp UNION ALL SELECT period, regexp_extract(entity, '^([^+]*)', 1), idx, value * 0.5e0 FROM yp),
s0 AS (SELECT period, entity, list_sort({_PART.format(1)}) AS bases, avg(value) AS score FROM yb GROUP BY ALL), fl AS (SELECT period, avg(floor_pct) AS floor FROM (SELECT DISTINCT period, idx, floor_pct FROM yp) GROUP BY period),
sb AS (SELECT a.period, a.entity, max(b.score) AS best FROM s0 a JOIN s0 b ON a.period = b.period AND len(b.bases) < len(a.bases) AND list_has_all(a.bases, b.bases) GROUP BY ALL),
sc AS (SELECT period, s0.entity, bases, score, floor, CASE WHEN len(bases) > 1 THEN score - coalesce(best, '-inf'::DOUBLE) END AS gain FROM s0 JOIN fl USING (period) LEFT JOIN sb USING (period, entity))"""


@query(f"WITH {SCORES} SELECT period, entity, array_to_string(bases, ';') AS bases, {r6('score', 'floor', 'gain')} FROM sc")
def subset_gain(spark, sf_dir):
    return rounded(_scores(spark, sf_dir).select("period", "entity", F.array_join("bases", ";").alias("bases"), "score", "floor", "gain"), "score", "floor", "gain")


def _slot_sql(slot: int) -> str:
    before = " ".join(f"AND NOT EXISTS (SELECT 1 FROM w{i} WHERE w{i}.period = nr.period AND list_has_any(w{i}.bases, nr.bases))" for i in range(1, slot))
    return f"w{slot} AS (SELECT {slot} AS slot, * FROM nr WHERE true {before} QUALIFY row_number() OVER (PARTITION BY period ORDER BY raw_rank) = 1)"


@query(f"""WITH {SCORES}, rr AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, entity) AS raw_rank FROM sc),
pa AS (SELECT * FROM rr WHERE score >= floor AND (gain IS NULL OR gain >= 0.5e0 * floor)), nr AS (SELECT * FROM pa WHERE score >= 0.6e0 * (SELECT max(score) FROM pa q WHERE q.period = pa.period)), {', '.join(map(_slot_sql, (1, 2, 3)))}
SELECT period, CAST(slot AS INTEGER) AS slot, entity, {r6('score', 'gain')}, CAST(raw_rank AS INTEGER) AS raw_rank, {r6('floor')} FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)""")
def pick_winners(spark, sf_dir):
    return rounded(attribution.pick_winners(_scores(spark, sf_dir)), "score", "gain", "floor")
