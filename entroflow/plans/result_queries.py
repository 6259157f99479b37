"""Queries on results, selections and checks, with their SQL: stage-2 job, unified frames, synergy, exports, coverage and small helpers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import align, normalize, stats
from ..sources import scratch
from . import attribution, catalog, estimates, knn_sql, rolling, store
from .more_queries import _ROWS1, _ROWS3, _V, _h, _mi, sample
from .queries import (
    EXACT, FACTS, HALF, JOINT, LAYERS, REPLICATES, S6, STEP1, Z6, _by_idx, _entropy_rows, _layers, _name, _over_z6, _periods, _te_oracle, _window_rows, binned, facts, load, query, r6, rounded, rounded_as_sql, wide,
)

_CLICK = (_name(["click"], [1], "view"), ["click"], "view")


# Rolling jobs ----------------------------------------------------------------------------------------------------------


@query(f"""WITH t AS ({_te_oracle([_CLICK], [1])}), h AS (SELECT window_idx, round(greatest(h_raw, 0), 6) AS h FROM ({_over_z6(knn_sql.entropy_sql(_entropy_rows()))}) WHERE entity = 'view')
SELECT 'click__t1' AS entity, window_idx, te_bits, h + 0e0 AS h_target_bits, round(CASE WHEN h > 0 THEN te_bits / h * 100 END, 4) AS pct_h, CAST(NULL AS VARCHAR) AS error FROM t LEFT JOIN h USING (window_idx)""")
def stage2_job(spark, sf_dir):
    s = rolling.stage2(wide(spark, sf_dir), [catalog.Entity("view", (("click", 1),))], 2 * HALF, 0)
    s = rounded(s, "te_bits", "h_target_bits")
    return s.select("entity", "window_idx", "te_bits", "h_target_bits", F.round(stats.percent_of(F.col("te_bits"), F.col("h_target_bits")), 4).alias("pct_h"), "error")


@query()
def stage2_with_surrogates(spark, sf_dir):
    return rolling.stage2(wide(spark, sf_dir), [catalog.Entity("view", (("click", 1),)), catalog.Entity("purchase", (("click", 1), ("view", 2)))], 2 * HALF, 100)


def _over(kind: str, entity, tau: list[int]) -> str:
    return f"SELECT '{entity[2]}' AS target, '{kind}' AS kind, window_idx, te_bits AS te FROM ({_te_oracle([entity], tau)})"


_PARTS = " UNION ALL ".join(p for s, t in JOINT for p in (_over("joint", (_name(s, [1, 2], t), list(s), t), [1, 2]), *(_over("single", (_name([b], [tau], t), [b], t), [tau]) for b, tau in zip(s, (1, 2)))))


@query(f"""WITH p AS ({_PARTS}), w AS (SELECT target, window_idx, max(te) FILTER (kind = 'joint') AS jte, sum(te) FILTER (kind = 'single') AS sum_te, max(te) FILTER (kind = 'single') AS max_te FROM p GROUP BY ALL)
SELECT target, window_idx, round(jte, 4) + 0e0 AS jte_bits, round(sum_te, 4) + 0e0 AS sum_te, round(max_te, 4) + 0e0 AS max_te, round(jte - sum_te, 4) + 0e0 AS synergy,
CASE WHEN jte - sum_te > 0.001 THEN 'SYNERGISTIC' WHEN jte - sum_te < -0.001 THEN 'REDUNDANT' ELSE 'INDEPENDENT' END AS label FROM w""")
def joint_synergy(spark, sf_dir):
    e = [x for s, t in JOINT for x in (catalog.Entity(t, tuple(zip(s, (1, 2)))), *(catalog.Entity(t, ((b, tau),)) for b, tau in zip(s, (1, 2))))]
    te = rolling.rolling_te(wide(spark, sf_dir), e, 2 * HALF).withColumn("te_bits", F.round("te_bits", 6) + 0.0)
    s = rolling.synergy(te)
    four = [(F.round(c, 4) + 0.0).alias(c) for c in ("jte_bits", "sum_te", "max_te", "synergy")]
    return s.select("target", "window_idx", *four, "label")


@query(f"""WITH {REPLICATES}, s AS (SELECT entity, window_idx, observed, quantile_cont(te_bits, 0.95) AS p95 FROM rp JOIN ob USING (entity, window_idx) GROUP BY ALL)
SELECT window_idx, 'signup__t0+' || entity || '__t1' AS entity, entity || '__t1+signup__t0 -> view' AS relationship, round(observed, 6) AS te_bits, observed > p95 AS sig95 FROM s WHERE entity < 'signup'""")
def significance_export(spark, sf_dir):
    e = load(spark, sf_dir, "events").where("event_type < 'signup'")
    first = load(spark, sf_dir, "events").agg(F.min(align.micros(F.col("ts"))).alias("a"))
    r = e.join(F.broadcast(first)).select(F.concat(F.lit("signup__t0+"), "event_type", F.lit("__t1")).alias("entity"), F.expr(f"(unix_micros(cast(ts as timestamp)) - a) div {24 * STEP1}").alias("window_idx"), F.col("value").alias("te_bits"))
    observed = r.groupBy("entity", "window_idx").agg((F.avg("te_bits") * 1.5).alias("te_bits")).withColumn("us", F.lit(0))
    s = rolling.significance(observed, r, ["entity", "window_idx"]).withColumn("target", F.lit("view"))
    return rounded(rolling.exported(s).select("window_idx", "entity", "relationship", "te_bits", "sig95"), "te_bits")


@query(f"""WITH {REPLICATES}, s AS (SELECT entity, CASE WHEN entity < 'purchase' THEN 'a' ELSE 'b' END AS target, window_idx, quantile_cont(te_bits, 0.95) AS p95 FROM rp GROUP BY ALL)
SELECT target, window_idx, round(max(p95), 6) AS level FROM s WHERE target IN (SELECT target FROM s GROUP BY target HAVING count(DISTINCT entity) >= 3) GROUP BY ALL""")
def family_level_withheld(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    first = e.agg(F.min(align.micros(F.col("ts"))).alias("a"))
    r = e.join(F.broadcast(first)).select(F.col("event_type").alias("entity"), F.expr(f"(unix_micros(cast(ts as timestamp)) - a) div {24 * STEP1}").alias("window_idx"), F.col("value").alias("te_bits"))
    s = r.groupBy("entity", "window_idx").agg(F.percentile("te_bits", F.lit(0.95)).alias("surr_p95")).withColumns({"target": F.when(F.col("entity") < "purchase", "a").otherwise("b"), "us": F.lit(0)})
    return rounded(rolling.family_level(s, 3).drop("us"), "level")


@query(f"""WITH t AS ({_te_oracle([_CLICK], [1])}), h AS (SELECT window_idx, round(greatest(h_raw, 0), 6) + 0e0 AS h_bits FROM ({_over_z6(knn_sql.entropy_sql(_entropy_rows()))}) WHERE entity = 'view') SELECT window_idx, te_bits, h_bits FROM t JOIN h USING (window_idx)""")
def te_in_sql(spark, sf_dir):
    """The estimators by name in SQL text, over the windows as arrays."""
    estimates.register(spark)
    wide(spark, sf_dir).createOrReplaceTempView("te_grid")
    return spark.sql(f"""WITH spread AS (SELECT explode(sequence(idx - {HALF - 1}, idx + {HALF})) AS c, struct(idx, click, view) AS r FROM te_grid),
a AS (SELECT c, array_sort(collect_list(r)) AS r FROM spread GROUP BY c HAVING count(*) = {2 * HALF})
SELECT c - {HALF} AS window_idx, round(te_bits(transform(r, x -> x.click), transform(r, x -> x.view), 1, 1), 6) + 0D AS te_bits, round(ksg_entropy(transform(r, x -> x.view)), 6) + 0D AS h_bits
FROM a WHERE c <= (SELECT max(idx) FROM te_grid) - {HALF}""")


@query(_te_oracle([(_name(["click"], [1], "view"), ["click"], "view"), (_name(["error"], [1], "signup"), ["error"], "signup")], [1]))
def stored_te(spark, sf_dir):
    """Window results from a store that other data filled before: it holds the first 50 rows' values and others after them."""
    w = wide(spark, sf_dir)
    e = [catalog.Entity("view", (("click", 1),)), catalog.Entity("signup", (("error", 1),))]
    path = scratch.path_for(spark, "te-store")
    store.rolling_te(w.withColumn("view", F.when(F.col("idx") < 50, F.col("view")).otherwise(F.col("view") * 2)), e, 2 * HALF, path)
    te = store.rolling_te(w, e, 2 * HALF, path)
    return rounded(te.select(F.concat_ws("", "entity", F.lit(" > "), "target").alias("entity"), "window_idx", "te_raw", "te_bits"), "te_raw", "te_bits")


# Surrogates by their invariants ----------------------------------------------------------------------------------------

#: Replicates of each window; a vector of two series beside a single one.
_DRAWN, _BASES, _VECTORS = 3, ["click", "wind"], {"wind": ["view", "signup"]}
_COMPONENTS = "SELECT 'click' AS base, 'click' AS col UNION ALL SELECT 'wind', 'view' UNION ALL SELECT 'wind', 'signup'"
_WINDOWS = f"""{Z6}, comp AS ({_COMPONENTS}),
win AS (SELECT base, c.idx - {HALF} AS window_idx, col, y.idx - c.idx + {HALF} AS pos, y.z FROM (SELECT DISTINCT idx FROM z6) c JOIN z6 y ON y.idx >= c.idx - {HALF} AND y.idx < c.idx + {HALF} JOIN comp ON col = y.series WHERE c.idx >= {HALF} AND c.idx <= (SELECT max(idx) FROM z6) - {HALF})"""


#: The same with 0 in gaps.
_FULL = _WINDOWS.replace("AS pos, y.z FROM", "AS pos, coalesce(y.z, 0) AS z FROM")


def _surrogates(spark, sf_dir, kind: str, full: bool = False):
    w = wide(spark, sf_dir)
    return rolling.surrogate_series(w.fillna(0.0) if full else w, _BASES, 2 * HALF, _DRAWN, kind, vector_bases=_VECTORS)


def _whole_windows(s):
    """Surrogates of windows without a gap."""
    gaps = s.groupBy("base", "window_idx").agg(F.count_if(F.col("value").isNull()).alias("_gaps")).where("_gaps = 0").drop("_gaps")
    return s.join(gaps, ["base", "window_idx"], "left_semi")


@query(f"""WITH {_WINDOWS}, o AS (SELECT base, window_idx, col, row_number() OVER (PARTITION BY base, window_idx, col ORDER BY z) AS place, z FROM win WHERE z IS NOT NULL),
whole AS (SELECT base, window_idx FROM win GROUP BY ALL HAVING count(*) = count(z))
SELECT kind, base, window_idx, replicate, col AS "column", place, round(z, 6) + 0e0 AS value FROM o CROSS JOIN (SELECT unnest(['shuffle', 'block', 'iaaft']) AS kind) CROSS JOIN (SELECT unnest(range({_DRAWN})) AS replicate)
WHERE (kind = 'block' AND base = 'click') OR (kind = 'iaaft' AND (base, window_idx) IN (SELECT (base, window_idx) FROM whole) AND base = 'click') OR (kind = 'shuffle' AND (base, window_idx) IN (SELECT (base, window_idx) FROM whole))""")
def surrogate_values(spark, sf_dir):
    """What permuting surrogates keep: the values of each window, in order of size; iaaft and whole rows of vectors too."""
    from pyspark.sql import Window

    drawn = _whole_windows(_surrogates(spark, sf_dir, "shuffle")).withColumn("kind", F.lit("shuffle"))
    drawn = drawn.unionByName(_surrogates(spark, sf_dir, "block").where("base = 'click' AND value IS NOT NULL").withColumn("kind", F.lit("block")))
    drawn = drawn.unionByName(_whole_windows(_surrogates(spark, sf_dir, "iaaft")).where("base = 'click'").withColumn("kind", F.lit("iaaft")))
    place = F.row_number().over(Window.partitionBy("kind", "base", "window_idx", "replicate", "column").orderBy("value")).cast("long")
    return rounded(drawn.select("kind", "base", "window_idx", "replicate", "column", place.alias("place"), "value"), "value")


@query(f"""WITH {_FULL}, whole AS (SELECT base, window_idx FROM win GROUP BY ALL HAVING count(*) = count(z)),
pairs AS (SELECT a.base, a.window_idx, a.pos, a.z AS x, b.z AS y FROM win a JOIN win b USING (base, window_idx, pos) WHERE a.col = 'view' AND b.col = 'signup' AND (a.base, a.window_idx) IN (SELECT (base, window_idx) FROM whole))
SELECT base, window_idx, replicate, count(*) AS n, round(sum(x * y), 6) + 0e0 AS together, round(sum(x), 6) + 0e0 AS sum_view, round(sum(y), 6) + 0e0 AS sum_signup FROM pairs CROSS JOIN (SELECT unnest(range({_DRAWN})) AS replicate) GROUP BY ALL""")
def surrogate_vector_rows(spark, sf_dir):
    """A vector's components are permuted together, so that the sum of their products stays."""
    s = _surrogates(spark, sf_dir, "shuffle", full=True).where("base = 'wind'")
    both = s.groupBy("base", "window_idx", "replicate", "at").agg(F.max(F.when(F.col("column") == "view", F.col("value"))).alias("x"), F.max(F.when(F.col("column") == "signup", F.col("value"))).alias("y"))
    sums = both.groupBy("base", "window_idx", "replicate").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("y")).alias("together"), F.sum("x").alias("sum_view"), F.sum("y").alias("sum_signup"))
    return rounded(sums, "together", "sum_view", "sum_signup")


_WAVE = f"2 * pi() * f * pos / {2 * HALF}"


@query(f"""WITH {_FULL}, whole AS (SELECT base, window_idx FROM win GROUP BY ALL HAVING count(*) = count(z)),
s AS (SELECT base, window_idx, col, f, sum(z * cos({_WAVE})) AS re, sum(z * sin({_WAVE})) AS im FROM win CROSS JOIN (SELECT unnest(range({HALF})) AS f) WHERE (base, window_idx) IN (SELECT (base, window_idx) FROM whole) GROUP BY ALL)
SELECT a.base, a.window_idx, replicate, a.f, round(a.re * a.re + a.im * a.im, 4) + 0e0 AS power, round(a.re * b.re + a.im * b.im, 4) + 0e0 AS shared FROM s a JOIN s b ON a.base = b.base AND a.window_idx = b.window_idx AND a.f = b.f AND a.col = CASE a.base WHEN 'click' THEN 'click' ELSE 'view' END AND b.col = CASE b.base WHEN 'click' THEN 'click' ELSE 'signup' END CROSS JOIN (SELECT unnest(range({_DRAWN})) AS replicate)""")
def surrogate_spectrum(spark, sf_dir):
    """What random phases keep, by direct sums at each frequency: the power, and between a vector's components the shared spectrum, as their phases turn together."""
    s = _surrogates(spark, sf_dir, "phase", full=True).withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1)).cast("array<bigint>")))
    wave = F.lit(2 * math.pi) * F.col("f") * F.col("at") / (2 * HALF)
    parts = s.groupBy("base", "window_idx", "replicate", "f", "column").agg(F.sum(F.col("value") * F.cos(wave)).alias("re"), F.sum(F.col("value") * F.sin(wave)).alias("im"))
    first = F.col("column").isin("click", "view")
    second = F.col("column").isin("click", "signup")
    at = lambda which, c: F.max(F.when(which, F.col(c)))
    both = parts.groupBy("base", "window_idx", "replicate", "f").agg(at(first, "re").alias("ar"), at(first, "im").alias("ai"), at(second, "re").alias("br"), at(second, "im").alias("bi"))
    out = both.select("base", "window_idx", "replicate", "f", F.expr("ar * ar + ai * ai").alias("power"), F.expr("ar * br + ai * bi").alias("shared"))
    return out.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("power", "shared")})


# Tests against permutations that SQL draws as well ------------------------------------------------------------------------

_PERMUTED = 40
_TESTED = [(("click",), (1,), "view"), (("error",), (1,), "signup"), (("click", "view"), (1, 2), "purchase"), (("signup", "error"), (1, 0), "view")]


def _replicates_sql(sources, taus, target) -> str:
    """entity, window_idx, te_bits of each replicate of one entity whose sources are permuted by digests."""
    n = range(len(sources))
    rows = _window_rows([(_name(sources, taus, target), list(sources), target)])
    own = "PARTITION BY entity, window_idx, rep"
    there = ", ".join(f"""p{i} AS (SELECT entity, window_idx, rep, idx, row_number() OVER ({own} ORDER BY idx) AS place FROM wr WHERE x{i + 1} IS NOT NULL),
d{i} AS (SELECT entity, window_idx, rep, x{i + 1} AS v{i}, row_number() OVER ({own} ORDER BY md5('0:' || entity || ':' || window_idx || ':' || rep || ':{i}:' || (idx - window_idx))) AS place FROM wr WHERE x{i + 1} IS NOT NULL),
s{i} AS (SELECT entity, window_idx, rep, idx, v{i} FROM p{i} JOIN d{i} USING (entity, window_idx, rep, place))""" for i in n)
    fake = f"SELECT entity || '#' || rep AS entity, window_idx, idx, {', '.join(f'v{i} AS x{i + 1}' for i in n)}, y FROM wr {' '.join(f'LEFT JOIN s{i} USING (entity, window_idx, rep, idx)' for i in n)}"
    te = knn_sql.te_sql("SELECT * FROM fake", taus)
    return f"SELECT split_part(entity, '#', 1) AS entity, window_idx, round(greatest(te_raw, 0), 6) + 0e0 AS te_bits FROM (WITH {Z6}, wr AS (SELECT *, unnest(range({_PERMUTED})) AS rep FROM ({rows})), {there}, fake AS ({fake}) SELECT * FROM ({te}))"


_OBSERVED = " UNION ALL ".join(f"SELECT entity, window_idx, te_bits AS observed FROM ({_te_oracle([(_name(s, t, y), list(s), y)], list(t))})" for s, t, y in _TESTED)
_FAKED = " UNION ALL ".join(_replicates_sql(s, t, y) for s, t, y in _TESTED)


@query(f"""WITH ob AS ({_OBSERVED}), rp AS ({_FAKED})
SELECT entity, window_idx, observed AS te_bits, count(*) AS n_valid, round(avg(te_bits), 6) + 0e0 AS surr_mean, round(stddev_pop(te_bits), 6) + 0e0 AS surr_std, round(quantile_cont(te_bits, 0.95), 6) + 0e0 AS surr_p95, round(quantile_cont(te_bits, 0.99), 6) + 0e0 AS surr_p99,
round(quantile_cont(te_bits, 0.025), 6) + 0e0 AS lower_ci, round(quantile_cont(te_bits, 0.975), 6) + 0e0 AS upper_ci, round(avg((te_bits >= observed)::DOUBLE), 6) AS p_value, observed > quantile_cont(te_bits, 0.95) AS sig95, observed > quantile_cont(te_bits, 0.99) AS sig99
FROM rp JOIN ob USING (entity, window_idx) GROUP BY entity, window_idx, observed""")
def permutation_significance(spark, sf_dir):
    """Single and joint sources against permuted ones, window by window: the whole test, from the draws to the flags."""
    w, e = wide(spark, sf_dir), [catalog.Entity(y, tuple(zip(s, t))) for s, t, y in _TESTED]
    te, drawn = (d.withColumn("te_bits", F.round("te_bits", 6).cast(EXACT)) for d in (rolling.rolling_te(w, e, 2 * HALF), rolling.surrogate_te(w, e, 2 * HALF, _PERMUTED, "shuffle", digests=True)))
    s = rolling.significance(te, drawn).withColumn("entity", F.concat_ws(" > ", "entity", "target")).drop("target", "us")
    return rounded(rounded_as_sql(s, "surr_p95", "surr_p99", "lower_ci", "upper_ci"), "te_bits", "surr_mean", "surr_std", "p_value")


_ALL_DIGITS = [f.replace("round(greatest(te_raw, 0), 6) + 0e0 AS te_bits", "greatest(te_raw, 0e0) AS te_bits") for f in (_OBSERVED.replace("te_bits AS observed", "te_bits"), _FAKED)]


@query(f"""WITH ob AS ({_ALL_DIGITS[0]}), rp AS ({_ALL_DIGITS[1]}), h AS (SELECT entity AS target, window_idx, greatest(h_raw, 0) AS h FROM ({_over_z6(knn_sql.entropy_sql(_entropy_rows()))})),
s AS (SELECT entity, window_idx, count(*) AS n_valid, avg(te_bits) AS mean, quantile_cont(te_bits, 0.95) AS p95 FROM rp GROUP BY ALL)
SELECT target, split_part(entity, ' > ', 1) AS entity, window_idx, round(te_bits, 6) + 0e0 AS te_bits, round(h, 6) + 0e0 AS h_target_bits, round(CASE WHEN h > 0 THEN te_bits / h * 100 END, 4) + 0e0 AS pct_h, n_valid, round(mean, 6) + 0e0 AS surr_mean, round(p95, 6) + 0e0 AS surr_p95, round(CASE WHEN h > 0 THEN p95 / h * 100 END, 4) + 0e0 AS surr_p95_pct
FROM ob JOIN s USING (entity, window_idx) JOIN h ON target = split_part(entity, ' > ', 2) AND h.window_idx = ob.window_idx""")
def stage2_permuted(spark, sf_dir):
    """The fixed-entity job with its surrogates, single and joint sources."""
    e = [catalog.Entity(y, tuple(zip(s, t))) for s, t, y in _TESTED]
    s = rounded(rolling.stage2(wide(spark, sf_dir), e, 2 * HALF, _PERMUTED, "shuffle", digests=True), "te_bits", "h_target_bits", "surr_mean", "surr_p95")
    four = [(F.round(c, 4) + 0.0).alias(c) for c in ("pct_h", "surr_p95_pct")]
    return s.select("target", "entity", "window_idx", "te_bits", "h_target_bits", four[0], "n_valid", "surr_mean", "surr_p95", four[1])


@query(f"""WITH rp AS ({_FAKED}), s AS (SELECT split_part(entity, ' > ', 2) AS target, entity, window_idx, quantile_cont(te_bits, 0.95) AS p95 FROM rp GROUP BY ALL)
SELECT target, window_idx, round(max(p95), 6) + 0e0 AS level FROM s WHERE target IN (SELECT target FROM s GROUP BY target HAVING count(DISTINCT entity) >= 2) GROUP BY ALL""")
def permuted_family_level(spark, sf_dir):
    """The level that a target's entities share, withheld where fewer than two were tested."""
    w, e = wide(spark, sf_dir), [catalog.Entity(y, tuple(zip(s, t))) for s, t, y in _TESTED]
    te, drawn = (d.withColumn("te_bits", F.round("te_bits", 6) + 0.0) for d in (rolling.rolling_te(w, e, 2 * HALF), rolling.surrogate_te(w, e, 2 * HALF, _PERMUTED, "shuffle", digests=True)))
    return rounded(rolling.family_level(rolling.significance(te, drawn), 2).select("target", "window_idx", "level"), "level")


# Estimators of several variables ------------------------------------------------------------------------------------------


def _rows2(a: str, b: str) -> str:
    return f"SELECT CAST(label AS VARCHAR) AS entity, 0 AS window_idx, vec_id AS idx, {a} AS x1, {b} AS x2 FROM v"


@query(f"""WITH a AS ({_h(_rows2('x1', 'x3'), 2)}), b AS ({_h(_rows2('x2', 'x3'), 2)}), c AS ({_h(_ROWS1.format('x3'), 1)}), d AS ({_h(_ROWS3, 3)})
SELECT CAST(a.entity AS INTEGER) AS label, round(a.h_raw + b.h_raw - c.h_raw - d.h_raw, 6) + 0e0 AS ctc FROM a JOIN b USING (entity) JOIN c USING (entity) JOIN d USING (entity)""")
def knn_conditional_correlation(spark, sf_dir):
    e = estimates.entropies(sample(spark, sf_dir), ["label"], "vec_id", {"a": ["x1", "x3"], "b": ["x2", "x3"], "c": ["x3"], "d": ["x1", "x2", "x3"]})
    return rounded(e.select("label", F.expr("a + b - c - d").alias("ctc")), "ctc")


@query(f"""WITH a AS ({_mi('x1', 'x3')}), b AS ({_mi('x2', 'x3')}), c AS ({_mi('x1 x2', 'x3')})
SELECT CAST(a.entity AS INTEGER) AS label, round(a.mi + b.mi - c.mi, 6) + 0e0 AS corex FROM a JOIN b USING (entity) JOIN c USING (entity)""")
def knn_explained_correlation(spark, sf_dir):
    d, own = sample(spark, sf_dir), (["label"], "vec_id")
    one, two, both = (estimates.information(d, *own, x, ["x3"], name=n) for n, x in (("a", ["x1"]), ("b", ["x2"]), ("c", ["x1", "x2"])))
    return rounded(one.join(two, "label").join(both, "label").select("label", F.expr("a + b - c").alias("corex")), "corex")


def _grouped(x: str) -> str:
    return _h(f"SELECT label || ':' || side AS entity, 0 AS window_idx, vec_id AS idx, {x} FROM v", x.count(",") + 1)


_V_LABELS = "SELECT label, side, n, sum(n) OVER (PARTITION BY label) AS t FROM (SELECT label, vec_id % 2 AS side, count(*) AS n FROM embeddings GROUP BY ALL)"


@query(f"""WITH a AS ({_grouped('x1')}), b AS ({_grouped('x2 AS x1')}), c AS ({_grouped('x1, x2')}), wa AS ({_h(_ROWS1.format('x1'), 1)}), wb AS ({_h(_ROWS1.format('x2'), 1)}), wc AS ({_h(_rows2('x1', 'x2'), 2)}),
g AS (SELECT l.label, sum(n / t * a.h_raw) AS ha, sum(n / t * b.h_raw) AS hb, sum(n / t * c.h_raw) AS hc FROM ({_V_LABELS}) l JOIN a ON a.entity = label || ':' || side JOIN b ON b.entity = a.entity JOIN c ON c.entity = a.entity GROUP BY l.label)
SELECT label, round(ha, 6) + 0e0 AS h_given, round(ha + hb - hc, 6) + 0e0 AS ctc_given, round(abs(wa.h_raw - ha) + abs(wb.h_raw - hb) - abs(wc.h_raw - hc), 6) + 0e0 AS corex_with FROM g JOIN wa ON wa.entity = CAST(label AS VARCHAR) JOIN wb ON wb.entity = wa.entity JOIN wc ON wc.entity = wa.entity""")
def mixed_family(spark, sf_dir):
    """Continuous x1, x2 and the discrete side: entropy given it, conditional total correlation, and the correlation it explains."""
    d, spaces = sample(spark, sf_dir), {"a": ["x1"], "b": ["x2"], "c": ["x1", "x2"]}
    whole = estimates.entropies(d, ["label"], "vec_id", spaces).selectExpr("label", "a AS wa", "b AS wb", "c AS wc")
    g = estimates.given_groups(d, ["label"], "vec_id", spaces, "side").join(whole, "label")
    return rounded(g.selectExpr("label", "a AS h_given", "a + b - c AS ctc_given", "abs(wa - a) + abs(wb - b) - abs(wc - c) AS corex_with"), "h_given", "ctc_given", "corex_with")


_CALIBRATION = f"""{Z6}, cw AS (SELECT idx, max(z) FILTER (series = 'view') AS y, max(z) FILTER (series = 'click') AS x1, max(z) FILTER (series = 'error') AS x2 FROM z6 GROUP BY idx),
cc AS (SELECT * FROM cw WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL), cm AS (SELECT quantile_cont(y, 0.5) AS my, quantile_cont(x1, 0.5) AS m1, quantile_cont(x2, 0.5) AS m2 FROM cc),
cd AS (SELECT quantile_cont(abs(y - my), 0.5) AS dy, quantile_cont(abs(x1 - m1), 0.5) AS d1, quantile_cont(abs(x2 - m2), 0.5) AS d2 FROM cc, cm),
cz AS (SELECT idx, 0.6745e0 * (y - my) / dy AS y, 0.6745e0 * (x1 - m1) / d1 AS x1, 0.6745e0 * (x2 - m2) / d2 AS x2 FROM cc, cm, cd)"""


@query(f"""WITH {_CALIBRATION}, i AS ({knn_sql.information_sql("SELECT 'all' AS entity, idx, x1, x2, y FROM cz", 2)}), h AS ({knn_sql.entropy_sql("SELECT 'all' AS entity, 0 AS window_idx, idx, y AS x1 FROM cz")}), s AS (SELECT pow(2e0, mi - h_raw) AS scale FROM i, h)
SELECT series, idx, round(z * scale, 6) + 0e0 AS z, round(scale, 6) AS scale FROM z6, s""")
def beta_normalised(spark, sf_dir):
    """Every variable's robust score under one scale, calibrated on the wide table."""
    scale = estimates.calibration(wide(spark, sf_dir), "idx", "view", ["click", "error"])["scale"]
    return rounded(normalize.robust_zscore(binned(spark, sf_dir), "value", ["series"], scale).select("series", "idx", "z", F.lit(scale).alias("scale")), "z", "scale")


@query(f"WITH {S6}, m AS (SELECT series, quantile_cont(value, 0.5) AS med FROM s6 GROUP BY series), a AS (SELECT series, med, quantile_cont(abs(value - med), 0.5) AS mad FROM s6 JOIN m USING (series) GROUP BY ALL) SELECT series, idx, round(0.6745e0 * (value - med) / mad, 6) + 0e0 AS z FROM s6 JOIN a USING (series)")
def strict_zscore(spark, sf_dir):
    return rounded(normalize.robust_zscore(binned(spark, sf_dir), "value", ["series"], strict=True).select("series", "idx", "z"), "z")


# Frames, selections and checks ----------------------------------------------------------------------------------------------


@query(f"""WITH {FACTS}, h AS (SELECT idx, sum(v) + 1 AS h FROM v6 GROUP BY idx), u AS (SELECT entity, idx, us, plotted_value AS bits FROM facts UNION ALL SELECT series || '__t0', idx, us, v FROM v6)
SELECT entity, idx, round(bits, 6) AS bits, round(bits / h * 100, 6) AS pct_h FROM u JOIN h USING (idx) WHERE idx < 80""")
def unified_frames(spark, sf_dir):
    s = binned(spark, sf_dir).select(F.col("series"), "idx", "us", (F.coalesce("value", F.lit(0.0)) / 1013).alias("bits"))
    h = s.groupBy("idx").agg((F.sum("bits") + 1).alias("h"))
    combos = facts(spark, sf_dir).select("entity", "idx", "us", F.col("plotted_value").alias("bits"))
    u = attribution.unified(combos, s.select(F.concat("series", F.lit("__t0")).alias("entity"), "idx", "us", "bits"), h, "idx", 80)
    return rounded(u.select("entity", "idx", "bits", "pct_h"), "bits", "pct_h")


@query(f"WITH {FACTS}, h AS (SELECT idx, sum(v) AS h FROM v6 GROUP BY idx) SELECT idx, CASE WHEN h > 0 THEN round(0.12e0 / h * 100, 6) END AS floor_pct FROM h")
def noise_floor(spark, sf_dir):
    h = binned(spark, sf_dir).groupBy("idx").agg(F.sum(F.coalesce("value", F.lit(0.0)) / 1013).alias("h"))
    return rounded(h.select("idx", attribution.noise_floor(F.lit(0.12), F.col("h")).alias("floor_pct")), "floor_pct")


@query(f"""WITH {LAYERS}, s AS (SELECT period, entity, avg(value) AS score, avg(baseline) AS baseline, sum(CASE WHEN active THEN excess ELSE 0 END) AS burst, avg(floor_pct) AS floor FROM yp GROUP BY ALL)
SELECT period, entity, round(score, 6) AS score, round(baseline, 6) AS baseline, round(burst, 6) AS burst, round(floor, 6) AS floor, score >= floor AS over_floor, rank() OVER (PARTITION BY period ORDER BY round(score, 6) DESC, entity) AS raw_rank FROM s""")
def period_attribution(spark, sf_dir):
    return rounded(attribution.attributed(_by_idx(_layers(spark, sf_dir)), _periods(spark)), "baseline", "burst", "floor").withColumn("score", F.round("score", 6) + 0.0)


@query(f"WITH {LAYERS} SELECT entity, round(sum(excess) FILTER (active), 6) AS integrated, round(max(value), 6) AS peak, min(idx) FILTER (value = m) AS peak_at FROM (SELECT *, max(value) OVER (PARTITION BY entity) AS m FROM ly) GROUP BY entity")
def integrated_bits(spark, sf_dir):
    return rounded(attribution.integrated(_layers(spark, sf_dir), "idx"), "integrated", "peak")


@query(f"WITH {FACTS}, s AS (SELECT entity, avg(plotted_value) AS mean, stddev_pop(plotted_value) / avg(plotted_value) AS cv FROM facts GROUP BY entity), p AS (SELECT entity FROM s ORDER BY round(mean, 9) DESC, entity LIMIT 4), e AS (SELECT entity FROM s WHERE entity NOT IN (SELECT entity FROM p) ORDER BY round(cv, 9) DESC, entity LIMIT 4) SELECT entity, 'persistent' AS panel FROM p UNION ALL SELECT entity, 'episodic' FROM e")
def panel_selection(spark, sf_dir):
    return attribution.panels(stats.series_stats(facts(spark, sf_dir), ["entity"], "plotted_value", "idx").withColumns({"mean": F.round("mean", 9), "cv": F.round("cv", 9)}))


@query(f"WITH {FACTS}, s AS (SELECT entity, avg(plotted_value) AS mean FROM facts GROUP BY entity), p AS (SELECT entity FROM s ORDER BY round(mean, 9) DESC, entity LIMIT 4) SELECT entity FROM s WHERE entity NOT IN (SELECT entity FROM p)")
def selection_coverage(spark, sf_dir):
    """Candidates that no panel shows."""
    f = facts(spark, sf_dir)
    shown = f.groupBy("entity").agg(F.round(F.avg("plotted_value"), 9).alias("mean")).orderBy(F.desc("mean"), "entity").limit(4).select("entity")
    return f.select("entity").distinct().exceptAll(shown)


@query(f"WITH {FACTS} SELECT entity, round(avg(plotted_value), 6) AS mean, round(max(plotted_value), 6) AS peak, row_number() OVER (ORDER BY round(avg(plotted_value), 6) DESC, entity) AS place FROM facts GROUP BY entity")
def selection_index(spark, sf_dir):
    return attribution.selection_index(facts(spark, sf_dir))


@query(f"WITH {FACTS} SELECT entity, {', '.join(f'round(avg({c}), 6) AS {p}_mean, round(max({c}), 6) AS {p}_peak, round(sum({c}), 6) AS {p}_total, round(stddev_pop({c}), 6) AS {p}_std' for p, c in (('plotted', 'plotted_value'), ('jte', 'jte_bits')))} FROM facts GROUP BY entity")
def flattened_stats(spark, sf_dir):
    f, out = facts(spark, sf_dir), None
    for prefix, column in (("plotted", "plotted_value"), ("jte", "jte_bits")):
        s = stats.series_stats(f, ["entity"], column, "idx").select("entity", *[F.col(c).alias(f"{prefix}_{c}") for c in ("mean", "peak", "total", "std")])
        out = s if out is None else out.join(s, "entity")
    return rounded(out, *[c for c in out.columns if c != "entity"])


@query(f"""WITH {LAYERS}, k AS (SELECT DISTINCT entity FROM ly WHERE length(entity) % 2 = 0), w AS (SELECT entity, idx, value, CASE WHEN count(value) OVER r >= 8 THEN quantile_cont(value, 0.5) OVER r END AS smooth, baseline FROM ly WINDOW r AS (PARTITION BY entity ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING))
SELECT entity, idx, round(CASE WHEN k.entity IS NOT NULL THEN baseline ELSE smooth END, 6) AS curve, CASE WHEN k.entity IS NOT NULL THEN 'baseline' ELSE 'smoothed' END AS source FROM w LEFT JOIN k USING (entity)""")
def fallback_curve(spark, sf_dir):
    d = _layers(spark, sf_dir)
    stored = d.where(F.length("entity") % 2 == 0).select("entity", "idx", "baseline")
    return rounded(attribution.fallback_curve(d.select("entity", "idx", "value"), stored, 24), "curve")


@query(f"WITH {FACTS} SELECT entity, idx, round(plotted_value, 6) AS value FROM facts WHERE entity = 'click__t0+view__t1' AND idx < 60")
def single_artifact(spark, sf_dir):
    """One entity's series up to a cutoff."""
    f = facts(spark, sf_dir).where("entity = 'click__t0+view__t1' AND idx < 60")
    return rounded(f.select("entity", "idx", F.col("plotted_value").alias("value")), "value")


@query(f"WITH {S6} SELECT series, idx, round(value, 6) AS value FROM s6, s6_l WHERE us + {HALF} * {6 * STEP1} >= a + 240 * {STEP1} AND us + {HALF} * {6 * STEP1} < a + 480 * {STEP1}")
def window_span(spark, sf_dir):
    """Windows, by their first row, whose centre lies in a span of time, its end excluded."""
    s = binned(spark, sf_dir)
    first = s.agg(F.min("us").alias("_a"))
    centre = F.col("us") + HALF * 6 * STEP1
    return rounded(s.join(F.broadcast(first)).where((centre >= F.col("_a") + 240 * STEP1) & (centre < F.col("_a") + 480 * STEP1)).select("series", "idx", "value"), "value")


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events ORDER BY ts, event_id LIMIT 12")
def preview(spark, sf_dir):
    """The first 12 rows by time, as a table view shows them."""
    return rounded(load(spark, sf_dir, "events").orderBy("ts", "event_id").limit(12).select("event_id", "event_type", "value"), "value")


@query("SELECT event_id, round(value / 2.838e6 * 86400, 9) AS mm_day FROM events")
def unit_conversion(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(stats.sublimation_mm_day(F.col("value")), 9).alias("mm_day"))


_LONGER = 150


@query(f"""WITH {S6}, n AS (SELECT series, count(*) AS n FROM s6 GROUP BY series), t AS (SELECT series, n, unnest(range({_LONGER})) AS i FROM n), p AS (SELECT series, i, i * (n - 1) / {_LONGER - 1}e0 AS x, least(CAST(floor(i * (n - 1) / {_LONGER - 1}e0) AS BIGINT), n - 2) AS lo FROM t)
SELECT p.series, i, round(coalesce(a.value, 0) + (x - lo) * (coalesce(b.value, 0) - coalesce(a.value, 0)), 6) AS value FROM p JOIN s6 a ON a.series = p.series AND a.idx = lo JOIN s6 b ON b.series = p.series AND b.idx = lo + 1""")
def length_interpolation(spark, sf_dir):
    s = binned(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return rounded(align.to_length(s, _LONGER, ["series"]), "value")


_ANGLE = "WITH a AS (SELECT event_type AS series, radians(value - 360 * floor(value / 360)) AS r, value FROM events)"


@query(f"{_ANGLE} SELECT series, count(*) AS n, count_if(value IS NULL) AS n_missing, round(max(abs(sin(r) ** 2 + cos(r) ** 2 - 1)), 9) AS worst, count_if(cos(r) > cos(radians(45))) AS n_northerly, round(stddev_pop(sin(r)) FILTER (cos(r) > cos(radians(45))), 6) AS northerly_spread FROM a GROUP BY series")
def circularity_check(spark, sf_dir):
    a = load(spark, sf_dir, "events").select(F.col("event_type").alias("series"), (F.col("value") - 360 * F.floor(F.col("value") / 360)).alias("degrees"))
    c = normalize.circularity(a, "degrees", ["series"])
    return c.withColumns({"worst": F.round("worst", 9), "northerly_spread": F.round("northerly_spread", 6)})


@query("SELECT event_type AS name, CAST(row_number() OVER (ORDER BY min(event_id)) AS BIGINT) AS place FROM events GROUP BY event_type")
def first_seen_distinct(spark, sf_dir):
    return catalog.first_seen(load(spark, sf_dir, "events"), "event_type", "event_id")


@query(f"WITH {S6} SELECT series, strftime(to_timestamp(us // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS time, round(value, 6) AS value FROM s6")
def packed_times(spark, sf_dir):
    return rounded(binned(spark, sf_dir).select("series", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("time"), "value"), "value")


@query(f"WITH {S6}, d AS (SELECT series, us - us % {24 * STEP1} AS us, avg(value) AS mean FROM s6 GROUP BY ALL) SELECT series, us, round(mean, 6) AS mean FROM d")
def daily_mean_kept(spark, sf_dir):
    """Daily means of the grid; a day without a value stays, without a mean."""
    s = binned(spark, sf_dir).groupBy("series", F.expr(f"us - us % {24 * STEP1}").alias("us")).agg(F.avg("value").alias("mean"))
    return rounded(s, "mean")


@query(f"WITH {S6}, v AS (SELECT series, idx, value FROM s6 WHERE value IS NOT NULL) SELECT series, (max(idx) - min(idx)) * 6 AS span_hours, count(*) AS n_valid, round(count(*) / (max(idx) - min(idx) + 1) * 100, 6) AS pct_of_span FROM v GROUP BY series")
def coverage_span(spark, sf_dir):
    v = binned(spark, sf_dir).where("value IS NOT NULL").groupBy("series").agg(((F.max("idx") - F.min("idx")) * 6).alias("span_hours"), F.count(F.lit(1)).alias("n_valid"), (F.max("idx") - F.min("idx") + 1).alias("_n"))
    return rounded(v.select("series", "span_hours", "n_valid", (F.col("n_valid") / F.col("_n") * 100).alias("pct_of_span")), "pct_of_span")


@query(f"""WITH {FACTS}, st AS (SELECT CASE WHEN entity LIKE '%view%' THEN 'purchase' ELSE 'view' END AS target, entity, us, jte_bits AS te_bits, plotted_value * 40 AS pct_h, idx % 3 = 0 AS sig95 FROM facts),
k AS (SELECT target, entity, min(us) AS peak_us FROM (SELECT *, max(pct_h) FILTER (pct_h <= 100) OVER (PARTITION BY target, entity) AS m FROM st) WHERE pct_h = m GROUP BY ALL),
g AS (SELECT st.target, st.entity, round(avg(pct_h) FILTER (pct_h <= 100), 6) AS mean_pct, round(max(pct_h) FILTER (pct_h <= 100), 6) AS peak_pct, any_value(peak_us) AS peak_us, count(*) FILTER (pct_h <= 100 AND sig95) AS n_sig, count(*) FILTER (pct_h <= 100) AS n, count(*) FILTER (pct_h > 100) AS n_over FROM st LEFT JOIN k USING (target, entity) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY mean_pct DESC, entity) AS BIGINT) AS place, 6 AS lag_hours FROM g""")
def entity_order(spark, sf_dir):
    """Statistics of all entities of all targets from one stacked table, in a figure's order, with the longest lag in hours of a 6-hour grid."""
    from pyspark.sql import Window

    f = facts(spark, sf_dir)
    st = f.select(F.when(F.col("entity").contains("view"), "purchase").otherwise("view").alias("target"), "entity", "us", "idx", F.col("jte_bits").alias("te_bits"), (F.col("plotted_value") * 40).alias("pct_h"), (F.col("idx") % 3 == 0).alias("sig95"))
    g = rounded(stats.entity_stats(st, ["target", "entity"]).select("target", "entity", "mean_pct", "peak_pct", "peak_us", "n_sig", "n", "n_over"), "mean_pct", "peak_pct")
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("mean_pct"), "entity")).cast("long")
    return catalog.with_lag_hours(g.withColumn("place", place), 6)
