"""Further queries with their SQL: grouped estimators, result statistics and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import near
from ..operators import align, stats
from . import catalog, estimates, knn_sql, rolling
from .queries import GAPPY, HALF, S1, S6, SWEPT, Z6, _name, _te_oracle, binned, gappy, load, query, rounded, wide, zscored


def sample(spark, sf_dir):
    """All vectors, with their first components as columns."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i + 1}") for i in range(3)])
    return e.withColumn("side", F.col("vec_id") % 2)


_V = "v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[3]::DOUBLE AS x3, vec_id % 2 AS side FROM embeddings)"


def _h(rows: str, dims: int, k: int = 3) -> str:
    return f"WITH {_V}, " + knn_sql.entropy_sql(rows, dims, k, 4).strip().removeprefix("WITH ")


_ROWS3 = "SELECT CAST(label AS VARCHAR) AS entity, 0 AS window_idx, vec_id AS idx, x1, x2, x3 FROM v"
_ROWS1 = "SELECT CAST(label AS VARCHAR) AS entity, 0 AS window_idx, vec_id AS idx, {} AS x1 FROM v"


@query(f"""WITH h3 AS ({_h(_ROWS3, 3)}), h1 AS ({_h(_ROWS1.format('x1'), 1)}), h2 AS ({_h(_ROWS1.format('x2'), 1)}), h4 AS ({_h(_ROWS1.format('x3'), 1)})
SELECT CAST(h3.entity AS INTEGER) AS label, round(h3.h_raw, 6) AS h, round(h3.h_raw - h4.h_raw, 6) AS h_joint_less_last, round(h1.h_raw + h2.h_raw + h4.h_raw - h3.h_raw, 6) + 0e0 AS tc FROM h3 JOIN h1 USING (entity) JOIN h2 USING (entity) JOIN h4 USING (entity)""")
def knn_entropy(spark, sf_dir):
    e = estimates.entropies(sample(spark, sf_dir), ["label"], "vec_id", {"h": ["x1", "x2", "x3"], "a": ["x1"], "b": ["x2"], "c": ["x3"]})
    return rounded(e.select("label", "h", (F.col("h") - F.col("c")).alias("h_joint_less_last"), F.expr("a + b + c - h").alias("tc")), "h", "h_joint_less_last", "tc")


@query(f"""WITH {_V}, p AS (SELECT a.label, a.side AS sa, b.side AS sb, a.vec_id, greatest(abs(a.x1 - b.x1), abs(a.x2 - b.x2)) AS d FROM v a JOIN v b ON a.label = b.label WHERE a.side = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY label, sb, vec_id ORDER BY d) AS pos FROM p), n AS (SELECT label, count_if(side = 0) AS n, count_if(side = 1) AS m FROM v GROUP BY label)
SELECT label, round((ln(any_value(m)) - ln(any_value(n) - 1) + 2 * (avg(CASE WHEN sb = 1 THEN ln(d) END) - avg(CASE WHEN sb = 0 THEN ln(d) END))) / ln(2), 6) AS kl FROM o JOIN n USING (label) WHERE (sb = 0 AND pos = 4) OR (sb = 1 AND pos = 3) GROUP BY label""")
def kl_divergence(spark, sf_dir):
    return rounded(estimates.divergence(sample(spark, sf_dir), ["label"], "vec_id", ["x1", "x2"], "side"), "kl")


@query(f"""WITH a AS ({_h(_ROWS1.format('x1'), 1)}), g AS ({_h("SELECT label || ':' || side AS entity, 0 AS window_idx, vec_id AS idx, x1 FROM v", 1)}), n AS (WITH {_V} SELECT label, side, count(*) AS n, sum(count(*)) OVER (PARTITION BY label) AS t FROM v GROUP BY label, side)
SELECT n.label, round(abs(any_value(a.h_raw) - sum(n.n / n.t * g.h_raw)), 6) AS mixed FROM n JOIN a ON a.entity = CAST(n.label AS VARCHAR) JOIN g ON g.entity = n.label || ':' || n.side GROUP BY n.label""")
def mixed_information(spark, sf_dir):
    d = sample(spark, sf_dir)
    whole = estimates.entropies(d, ["label"], "vec_id", {"h": ["x1"]}).select("label", "h")
    both = whole.join(estimates.given_groups(d, ["label"], "vec_id", {"g": ["x1"]}, "side"), "label")
    return rounded(both.select("label", F.abs(F.col("h") - F.col("g")).alias("mixed")), "mixed")


def _mi(x: str, y: str) -> str:
    parts = ", ".join(f"{c} AS x{i + 1}" for i, c in enumerate(x.split()))
    return f"WITH {_V}, " + knn_sql.information_sql(f"SELECT CAST(label AS VARCHAR) AS entity, vec_id AS idx, {parts}, {y} AS y FROM v", len(x.split())).strip().removeprefix("WITH ")


# In two dimensions the principal axes of a neighbourhood are turned by half the angle of (2 uw, uu - ww).
@query(f"""WITH {_V}, i AS ({_mi('x1', 'x2')}),
n AS (SELECT a.label, a.vec_id, b.x1 - a.x1 AS u, b.x2 - a.x2 AS w, row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY greatest(abs(b.x1 - a.x1), abs(b.x2 - a.x2))) AS pos FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
m AS (SELECT *, atan2(2 * sum(u * w) OVER r, sum(u * u) OVER r - sum(w * w) OVER r) / 2 AS t FROM n WHERE pos <= 3 WINDOW r AS (PARTITION BY label, vec_id)),
c AS (SELECT label, ln(max(abs(u * cos(t) + w * sin(t)))) + ln(max(abs(w * cos(t) - u * sin(t)))) AS turned, ln(max(abs(u))) + ln(max(abs(w))) AS straight FROM m GROUP BY label, vec_id)
SELECT label, round(mi, 6) + 0e0 AS mi, round(mi + avg(CASE WHEN turned < straight + ln(0.25e0) THEN straight - turned ELSE 0e0 END) / ln(2e0), 6) + 0e0 AS mi_corrected FROM c JOIN i ON i.entity = CAST(label AS VARCHAR) GROUP BY label, mi""")
def corrected_information(spark, sf_dir):
    d = sample(spark, sf_dir)
    both = estimates.information(d, ["label"], "vec_id", ["x1"], ["x2"]).join(estimates.corrections(d, ["label"], "vec_id", ["x1", "x2"], 0.25), "label")
    return rounded(both.select("label", "mi", (F.col("mi") + F.col("lnc")).alias("mi_corrected")), "mi", "mi_corrected")


#: Replicates of the permutation tests, the estimator's default.
SHUFFLES = 200
_DRAWN = f"""{_V}, rr AS (SELECT *, UNNEST(range({SHUFFLES})) AS rep FROM v),
dr AS (SELECT label, rep, x1, row_number() OVER (PARTITION BY label, rep ORDER BY md5(vec_id || ':' || rep), vec_id) AS pos FROM rr),
fx AS (SELECT label, rep, vec_id, x2, side, row_number() OVER (PARTITION BY label, rep ORDER BY vec_id) AS pos FROM rr),
pa AS (SELECT fx.label, fx.label || ':' || fx.rep AS entity, vec_id AS idx, x1, x2 AS y, side FROM fx JOIN dr USING (label, rep, pos))"""
_BOUNDS = f"round(avg(mi), 6) + 0e0 AS mean, round(list_sort(list(mi))[{int(0.025 * SHUFFLES) + 1}], 6) + 0e0 AS low, round(list_sort(list(mi))[{int(0.975 * SHUFFLES) + 1}], 6) + 0e0 AS high"


@query(f"""WITH {_DRAWN}, i AS ({knn_sql.information_sql('SELECT entity, idx, x1, y FROM pa')})
SELECT label, {_BOUNDS} FROM i JOIN (SELECT DISTINCT label, entity FROM pa) USING (entity) GROUP BY label""")
def shuffle_test(spark, sf_dir):
    return rounded(estimates.shuffle_test(sample(spark, sf_dir), ["label"], "vec_id", ["x1"], ["x2"], ns=SHUFFLES), "mean", "low", "high")


@query(f"""WITH {_DRAWN}, a AS ({_h(_ROWS1.format('x1'), 1)}), g AS ({knn_sql.entropy_sql("SELECT entity || ':' || side AS entity, 0 AS window_idx, idx, x1 FROM pa", 1, 3, 4)}),
i AS (SELECT pg.label, pg.entity, abs(any_value(a.h_raw) - sum(n / t * CASE WHEN n > 3 THEN g.h_raw ELSE a.h_raw END)) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY entity) AS t FROM (SELECT label, entity, side, count(*) AS n FROM pa GROUP BY ALL)) pg JOIN a ON a.entity = CAST(pg.label AS VARCHAR) JOIN g ON g.entity = pg.entity || ':' || pg.side GROUP BY pg.label, pg.entity)
SELECT label, {_BOUNDS} FROM i GROUP BY label""")
def shuffle_test_mixed(spark, sf_dir):
    """The permutation test of another measure: the information between x1 and the discrete side."""
    measure = lambda d, keys: estimates.mixed_information(d, keys, "vec_id", ["x1"], ["side"])
    return rounded(estimates.shuffle_test(sample(spark, sf_dir), ["label"], "vec_id", ["x1"], ["side"], ns=SHUFFLES, measure=measure, alone=lambda x, y, z: near.mixed_information(x, y)), "mean", "low", "high")


def _given(side: str) -> str:
    """A table (label, m): the information between (x1, x2) and a discrete expression of vec_id; needs w3."""
    g = _h(f"SELECT label || ':' || ({side}) AS entity, 0 AS window_idx, vec_id AS idx, x1, x2 FROM v", 2)
    n = f"SELECT label, s, n, sum(n) OVER (PARTITION BY label) AS t FROM (SELECT label, {side} AS s, count(*) AS n FROM embeddings GROUP BY ALL)"
    return f"SELECT l.label, abs(any_value(w3.h_raw) - sum(n / t * CASE WHEN n > 3 THEN g.h_raw ELSE w3.h_raw END)) AS m FROM ({n}) l JOIN ({g}) g ON g.entity = l.label || ':' || l.s JOIN w3 ON w3.entity = CAST(l.label AS VARCHAR) GROUP BY l.label"


def _bits(x: str) -> str:
    return f"SELECT label, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS d FROM (SELECT label, {x} AS s, count(*) AS n FROM embeddings GROUP BY ALL) GROUP BY label"


_ROWS12 = "SELECT CAST(label AS VARCHAR) AS entity, 0 AS window_idx, vec_id AS idx, x1, x2 FROM v"


@query(f"""WITH w2 AS ({_h(_ROWS12, 2, 2)}), w3 AS ({_h(_ROWS12, 2)}), a AS ({_given('vec_id % 2')}), b AS ({_given('vec_id // 2 % 2')}), c AS ({_given('vec_id % 4')}), da AS ({_bits('vec_id % 2')}), db AS ({_bits('vec_id // 2 % 2')}), dc AS ({_bits('vec_id % 4')}),
r AS (SELECT label, w2.h_raw - c.m AS h_given, w2.h_raw - a.m - b.m + c.m AS ctc, da.d + db.d - dc.d AS tc FROM a JOIN b USING (label) JOIN c USING (label) JOIN da USING (label) JOIN db USING (label) JOIN dc USING (label) JOIN w2 ON w2.entity = CAST(label AS VARCHAR))
SELECT label, round(h_given, 6) + 0e0 AS h_given, round(ctc, 6) + 0e0 AS ctc, round(tc - ctc, 6) + 0e0 AS corex FROM r""")
def mixed_correlations(spark, sf_dir):
    """Continuous (x1, x2) and two discrete columns: the published entropy, conditional total correlation and explained correlation."""
    d = sample(spark, sf_dir).withColumn("half", F.expr("vec_id div 2 % 2"))
    return rounded(estimates.mixed_correlations(d, ["label"], "vec_id", ["x1", "x2"], ["side", "half"]), "h_given", "ctc", "corex")


@query()
def te_array_function(spark, sf_dir):
    w = wide(spark, sf_dir).select("idx", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in ("click", "view")])
    # Each row goes to the windows that hold it.
    spread = w.select(F.explode(F.sequence(F.col("idx") - HALF + 1, F.col("idx") + HALF)).alias("c"), F.struct("idx", "click", "view").alias("r"))
    arrays = spread.groupBy("c").agg(F.array_sort(F.collect_list("r")).alias("r")).join(w.select(F.col("idx").alias("c")), "c", "left_semi")
    d = arrays.select(F.col("c").alias("idx"), F.transform("r", lambda r: r["click"]).alias("x"), F.transform("r", lambda r: r["view"]).alias("y"))
    return d.select("idx", estimates.te_bits(F.col("x"), F.col("y")).alias("te_bits"), estimates.ksg_entropy("y").alias("h_bits"))


@query(f"""WITH {S1}, c AS (SELECT series, idx, value - avg(value) OVER (PARTITION BY series) AS c, count(*) OVER (PARTITION BY series) AS n FROM (SELECT series, idx, coalesce(value, 0) AS value FROM s1)),
a AS (SELECT a.series, b.idx - a.idx AS lag, a.n, sum(a.c * b.c) AS s FROM c a JOIN c b ON a.series = b.series AND b.idx >= a.idx GROUP BY ALL)
SELECT series, greatest(2, least(coalesce(min(lag) FILTER (lag > 0 AND s / z < exp(-1)), CAST(floor(any_value(n) / 10) AS BIGINT)), CAST(floor(any_value(n) / 3) AS BIGINT))) AS block FROM a JOIN (SELECT series, s AS z FROM a WHERE lag = 0) USING (series) GROUP BY series""")
def block_length(spark, sf_dir):
    return stats.block_length(binned(spark, sf_dir, 1).withColumn("value", F.coalesce("value", F.lit(0.0))), ["series"])


@query(f"""WITH {_V}, m AS (SELECT label, avg(x1) AS mx, avg(x2) AS my FROM v GROUP BY label), d AS (SELECT label, mx, my, x1 - mx AS u, x2 - my AS w FROM v JOIN m USING (label)),
s AS (SELECT label, mx, my, avg(u * u) AS uu, avg(w * w) AS vv, avg(u * w) AS uv, avg(u * (u * u + w * w)) AS a, avg(w * (u * u + w * w)) AS b FROM d GROUP BY ALL),
c AS (SELECT *, (a * vv - b * uv) / (2 * (uu * vv - uv * uv)) AS cu, (b * uu - a * uv) / (2 * (uu * vv - uv * uv)) AS cv FROM s)
SELECT label, round(mx + cu, 6) + 0e0 AS cx, round(my + cv, 6) + 0e0 AS cy, round(sqrt(cu * cu + cv * cv + uu + vv), 6) AS radius FROM c""")
def circle_fit(spark, sf_dir):
    return rounded(stats.circle_fit(sample(spark, sf_dir), "x1", "x2", ["label"]), "cx", "cy", "radius")


def _stage2(spark, sf_dir):
    s = binned(spark, sf_dir).where("value IS NOT NULL")
    return s.select(F.col("series").alias("entity"), "us", "idx", (F.col("value") / 1013).alias("te_bits"), (F.col("value") / F.lit(7.7)).alias("pct_h"), (F.col("idx") % 3 == 0).alias("sig95"))


_STAGE2 = f"{S6}, st AS (SELECT series AS entity, us, idx, value / 1013 AS te_bits, value / 7.7e0 AS pct_h, idx % 3 = 0 AS sig95 FROM s6 WHERE value IS NOT NULL)"


@query(f"""WITH {_STAGE2}, k AS (SELECT entity, min(us) AS peak_us FROM (SELECT *, max(pct_h) FILTER (pct_h <= 100) OVER (PARTITION BY entity) AS m FROM st) WHERE pct_h = m GROUP BY entity)
SELECT st.entity, round(avg(pct_h) FILTER (pct_h <= 100), 6) AS mean_pct, round(max(pct_h) FILTER (pct_h <= 100), 6) AS peak_pct, round(avg(te_bits) FILTER (pct_h <= 100), 6) AS mean_bits, round(max(te_bits) FILTER (pct_h <= 100), 6) AS peak_bits,
 any_value(peak_us) AS peak_us, count(*) FILTER (pct_h <= 100 AND sig95) AS n_sig, count(*) FILTER (pct_h <= 100) AS n, count(*) FILTER (pct_h > 100) AS n_over FROM st LEFT JOIN k USING (entity) GROUP BY st.entity""")
def entity_stats(spark, sf_dir):
    return rounded(stats.entity_stats(_stage2(spark, sf_dir), ["entity"]), "mean_pct", "peak_pct", "mean_bits", "peak_bits")


@query(f"""WITH {_STAGE2}, b AS (SELECT *, us < (SELECT min(us) FROM s6) + 60 * {6 * align.HOUR} AS pre FROM st) SELECT entity, round(avg(te_bits) FILTER (pre), 6) AS mean_before, round(avg(te_bits) FILTER (NOT pre), 6) AS mean_after, count(*) FILTER (pre AND sig95) AS sig_before, count(*) FILTER (NOT pre AND sig95) AS sig_after,
round(max(te_bits) FILTER (pre), 6) AS peak_before, round(max(te_bits) FILTER (NOT pre), 6) AS peak_after, max(us) FILTER (sig95) AS last_sig_us FROM b GROUP BY entity""")
def before_after(spark, sf_dir):
    s = binned(spark, sf_dir)
    at = s.agg(F.min("us")).first()[0] + 60 * 6 * align.HOUR
    return rounded(stats.before_after(_stage2(spark, sf_dir), ["entity"], at), "mean_before", "mean_after", "peak_before", "peak_after")


_SWEEP = " UNION ALL ".join(f"SELECT entity, window_idx, te_bits, {h} AS history FROM ({_te_oracle([(_name([a], [1], b), [a], b) for a, b in SWEPT], [1], h)})" for h in (1, 2, 3, 4))


@query(f"""WITH w AS ({_SWEEP}), f AS (SELECT w.*, o.te_bits AS first FROM w JOIN w o ON o.entity = w.entity AND o.window_idx = w.window_idx AND o.history = 1),
r AS (SELECT *, rank() OVER (PARTITION BY entity, history ORDER BY te_bits) + (count(*) OVER (PARTITION BY entity, history, te_bits) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY entity, history ORDER BY first) + (count(*) OVER (PARTITION BY entity, history, first) - 1) / 2e0 AS rb, te_bits >= quantile_cont(te_bits, 0.9) OVER (PARTITION BY entity, history) AS ta, first >= quantile_cont(first, 0.9) OVER (PARTITION BY entity, history) AS tb FROM f)
SELECT entity, history, round(avg(te_bits), 4) AS mean, round(quantile_cont(te_bits, 0.5), 4) AS median, round(stddev_pop(te_bits), 4) AS std, round(max(te_bits), 4) AS max, round(corr(ra, rb), 4) AS rho, round(count_if(ta AND tb) / count_if(ta OR tb), 4) AS jaccard, round(avg(te_bits) / avg(first), 4) AS ratio, CAST(history + 2 AS BIGINT) AS joint_dim, CAST(3 * power(2, history + 2) AS BIGINT) AS n_min, 3 * power(2, history + 2) > {2 * HALF} AS undersampled FROM r GROUP BY entity, history""")
def history_sensitivity(spark, sf_dir):
    te = rolling.rolling_te(wide(spark, sf_dir), [catalog.Entity(b, ((a, 1),), h) for h in (1, 2, 3, 4) for a, b in SWEPT], 2 * HALF)
    te = te.withColumns({"te_bits": F.round("te_bits", 6), "entity": F.concat_ws("", "entity", F.lit(" > "), "target")})
    s = stats.history_sensitivity(te, 2 * HALF, ["entity"])
    return s.select("entity", "history", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "max", "rho", "jaccard", "ratio")], "joint_dim", "n_min", "undersampled")


@query(f"WITH {Z6}, r AS (SELECT series, z * 0.37e0 / z AS q FROM z6 WHERE z <> 0) SELECT series, round(quantile_cont(q, 0.5), 6) AS factor, round(stddev_pop(q), 6) + 0e0 AS spread FROM r GROUP BY series")
def scale_recovery(spark, sf_dir):
    z = zscored(spark, sf_dir).withColumn("b", F.col("z") * 0.37)
    return rounded(stats.scale_recovery(z, "b", "z", ["series"]), "factor", "spread")


@query(f"WITH {S1}, {GAPPY} SELECT round((SELECT avg(c) FROM (SELECT count(value) / count(*) AS c FROM gp GROUP BY series)), 6) AS coverage, (SELECT count(*) FROM (SELECT DISTINCT us FROM gp WHERE idx > 5) a FULL JOIN (SELECT DISTINCT us FROM gp WHERE idx < 90) b USING (us) WHERE a.us IS NULL OR b.us IS NULL) AS mismatches")
def alignment_checks(spark, sf_dir):
    g = gappy(spark, sf_dir)
    m = stats.mismatched_rows(g.where("idx > 5").select("us").distinct(), g.where("idx < 90").select("us").distinct(), "us")
    return rounded(stats.mean_coverage(g, ["series"]).join(m), "coverage")
