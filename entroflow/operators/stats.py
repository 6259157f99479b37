"""Statistics of per-window series: descriptors, coverage, episodes, baselines and agreement measures.

Tables are long: key columns, us (time in microseconds) or idx, and a value that is null where missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import ranks, scan
from .align import runs

TINY = 1e-12


def half(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


def series_stats(df: DataFrame, keys: Sequence[str], value: str = "value", order: str = "us") -> DataFrame:
    """n, total, mean, peak, peak_at (its first place), std (population), cv, gini, by key."""
    there = df.where(F.col(value).isNotNull()).withColumn("_c", F.greatest(F.col(value), F.lit(0.0)))
    s = there.groupBy(*keys).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("peak"),
        F.max_by(order, F.struct(F.col(value), -F.col(order))).alias("peak_at"), F.stddev_pop(value).alias("std"), F.sum("_c").alias("_sum"),
    )
    s = scan.same(s, ranks.rank_sums(there.select(*keys, "_c"), keys, "_c", "_weighted"), keys, "left")
    cv = F.when((F.col("n") >= 2) & (F.abs("mean") >= TINY), F.col("std") / F.col("mean"))
    gini = F.when(F.col("_sum") > 0, 2 * F.col("_weighted") / (F.col("n") * F.col("_sum")) - (F.col("n") + 1) / F.col("n"))
    return s.withColumns({"cv": cv, "gini": gini}).drop("_sum", "_weighted")


def describe(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """min, max, mean, std (sample), median, q1, q3 and iqr, by key; quantiles are exact for keys of any size."""
    q = ranks.quantiles(df.select(*keys, value), keys, value, {"median": 0.5, "q1": 0.25, "q3": 0.75})
    s = df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return scan.same(s, q, keys).withColumn("iqr", F.col("q3") - F.col("q1"))


def coverage(df: DataFrame, keys: Sequence[str], value: str = "value", order: str = "idx", us: str = "us") -> DataFrame:
    """n_grid, n_valid, pct, first and last valid time, and within these n_gaps and the longest gap in points."""
    r = runs(df, F.col(value).isNotNull(), order, keys)
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    inside = r.join(ends, list(keys)).where((F.col(us) > F.col("first_us")) & (F.col(us) < F.col("last_us")) & F.col(value).isNull())
    lengths = inside.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("len"))
    g = lengths.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"), F.max("len").alias("longest_gap"))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_grid"), F.count(value).alias("n_valid"))
    zero = F.lit(0).cast("long")
    return n.join(ends, list(keys), "left").join(g, list(keys), "left").withColumns({"pct": F.col("n_valid") / F.col("n_grid") * 100, "n_gaps": F.coalesce("n_gaps", zero), "longest_gap": F.coalesce("longest_gap", zero)})


def extremes(df: DataFrame, keys: Sequence[str], k: int, value: str = "value", us: str = "us") -> DataFrame:
    """The k smallest and largest values of each key with their times and ranks; ties go to the earlier time."""
    out = []
    for name, by in (("low", F.asc(value)), ("high", F.desc(value))):
        w = Window.partitionBy(*keys).orderBy(by, us)
        out.append(df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).withColumn("side", F.lit(name)))
    return out[0].unionByName(out[1])


def rolling_median(df: DataFrame, keys: Sequence[str], n: int, value: str = "value", order: str = "idx", least: int | None = None) -> DataFrame:
    """df with baseline: the median of n rows around each, from n // 2 before on; null with under `least` values."""
    return scan.rolling_median(df, keys, n, value, order, max(3, n // 3) if least is None else least)


def rolling_mean(df: DataFrame, keys: Sequence[str], n: int, value: str = "value", order: str = "idx") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n // 2), n - 1 - n // 2)
    return df.withColumn("smooth", F.avg(value).over(w))


def baseline_windows(days: float, per_day: int = 4) -> int:
    return max(8, round(days * per_day))


def excess(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("excess", F.greatest(F.lit(0.0), F.col(value) - F.col("baseline")))


def bridged(df: DataFrame, active: Column, keys: Sequence[str], max_gap: int, valid: Column | None = None, order: str = "idx") -> DataFrame:
    """df with active: the flag, and inactive runs of at most max_gap rows between active ones, all of them valid."""
    d = df.withColumn("active", F.coalesce(active, F.lit(False))).withColumn("_valid", F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    d = scan.with_run_facts(scan.numbered(d, F.col("active"), order, keys), keys, order, "_valid")
    fill = (F.col("run") > F.col("_first_run")) & (F.col("run") < F.col("_last_run")) & (F.col("_rows") <= max_gap) & F.col("_whole")
    return d.withColumn("active", F.col("active") | fill).select(*df.columns, *(["active"] if "active" not in df.columns else []))


def long_runs(df: DataFrame, keys: Sequence[str], least: int, order: str = "idx") -> DataFrame:
    """df with active only in runs of at least `least` rows, and the run's number."""
    d = scan.with_run_facts(scan.numbered(df, F.col("active"), order, keys), keys, order)
    return d.withColumn("active", F.col("active") & (F.col("_rows") >= least)).select(*df.columns, "run")


def episode_rows(df: DataFrame, keys: Sequence[str], k: float = 1.0, least: int = 2, max_gap: int = 0, floor: float | None = None, valid: Column | None = None, value: str = "value", order: str = "idx") -> DataFrame:
    """df with active: whether a row lies in an episode, a run above max(median + k * 1.4826 * MAD, floor)."""
    d = df.withColumn("_ok", F.col(value).isNotNull() & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))))
    d = materialize(d, "episodes")
    good = d.where("_ok")
    d = scan.same(d, ranks.quantiles(good, keys, value, {"_med": 0.5}), keys, "left")
    d = scan.same(d, ranks.quantiles(d.where("_ok").withColumn("_off", F.abs(F.col(value) - F.col("_med"))), keys, "_off", {"_mad": 0.5}), keys, "left")
    cut = F.col("_med") + F.lit(k * 1.4826) * F.col("_mad")
    if floor is not None:
        cut = F.greatest(cut, F.lit(float(floor)))
    d = bridged(d, F.col("_ok") & (F.col(value) > cut), keys, max_gap, valid, order) if max_gap > 0 else d.withColumn("active", F.coalesce(F.col("_ok") & (F.col(value) > cut), F.lit(False)))
    return long_runs(d, keys, least, order).drop("_ok", "_med", "_mad")


def episodes(rows: DataFrame, keys: Sequence[str], value: str = "value", order: str = "idx") -> DataFrame:
    """One row an episode of episode_rows: first, last, n_windows, peak_value and its first place."""
    return rows.where("active").groupBy(*keys, "run").agg(
        F.min(order).alias("first_idx"), F.max(order).alias("last_idx"), F.count(F.lit(1)).alias("n_windows"), F.max(value).alias("peak_value"), F.max_by(order, F.struct(F.col(value), -F.col(order))).alias("peak_idx")
    ).drop("run")


def episode_alignment(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean of value in episodes (active) over that outside; null if a side is empty or the outside mean vanishes."""
    s = df.groupBy(*keys).agg(F.avg(F.when(F.col("active"), F.col(value))).alias("_in"), F.avg(F.when(~F.col("active"), F.col(value))).alias("_out"))
    return s.select(*keys, F.when(F.abs("_out") >= TINY, F.col("_in") / F.col("_out")).alias("alignment"))


def category_fractions(df: DataFrame, keys: Sequence[str], category: str, names: Sequence[str], order: str = "idx") -> DataFrame:
    """Share of rows in each category and the number of changes between consecutive rows."""
    known = runs(df.where(F.col(category).isNotNull()), F.col(category), order, keys)
    return known.groupBy(*keys).agg(*[F.avg((F.col(category) == n).cast("double")).alias(f"frac_{n}") for n in names], (F.max("run") - 1).alias("n_flips"))


def agreement(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r, mean bias b - a and RMSE of the rows that have both."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = F.col(b) - F.col(a)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"))


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = ranks.with_ranks(ranks.with_ranks(both, keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("rho"))


def top_jaccard(df: DataFrame, a: str, b: str, q: float = 0.9, keys: Sequence[str] = ()) -> DataFrame:
    """Overlap of the rows in the top of each: both at least at their own quantile over either."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c, name in ((a, "_qa"), (b, "_qb")):
        d = scan.same(d, ranks.of_ranked(ranks.ranked_values(d, keys, c), keys, c, {name: q}), keys)
    in_a, in_b = F.col(a) >= F.col("_qa"), F.col(b) >= F.col("_qb")
    return d.groupBy(*keys).agg((F.count_if(in_a & in_b) / F.nullif(F.count_if(in_a | in_b), F.lit(0))).alias("jaccard"))


def step_means(df: DataFrame, keys: Sequence[str], boundary_us: int, days: float = 30, value: str = "value", us: str = "us") -> DataFrame:
    """Means before and from a boundary on, over all rows and within `days` of it."""
    before, near = F.col(us) < boundary_us, F.abs(F.col(us) - F.lit(boundary_us)) <= int(days * 86_400_000_000)
    m = lambda c: F.avg(F.when(c, F.col(value)))
    return df.groupBy(*keys).agg(m(before).alias("before"), m(~before).alias("after"), m(before & near).alias("before_near"), m(~before & near).alias("after_near"))


def percent_of(x: Column, whole: Column) -> Column:
    """x in per cent of whole, null unless whole is positive."""
    return F.when(whole > 0, x / whole * 100)


def entity_stats(df: DataFrame, keys: Sequence[str], most: float = 100.0) -> DataFrame:
    """Of rows (us, te_bits, pct_h, sig95): means and peaks over windows of at most `most` per cent, the peak's first time, and counts."""
    ok = F.col("pct_h") <= most
    v = lambda c: F.when(ok, F.col(c))
    return df.groupBy(*keys).agg(
        F.avg(v("pct_h")).alias("mean_pct"), F.max(v("pct_h")).alias("peak_pct"), F.avg(v("te_bits")).alias("mean_bits"), F.max(v("te_bits")).alias("peak_bits"),
        F.max_by(F.when(ok, F.col("us")), F.when(ok, F.struct(F.col("pct_h"), -F.col("us")))).alias("peak_us"), F.count_if(ok & F.col("sig95")).alias("n_sig"), F.count_if(ok).alias("n"), F.count_if(F.col("pct_h") > most).alias("n_over"),
    )


def before_after(df: DataFrame, keys: Sequence[str], boundary_us: int) -> DataFrame:
    """Of rows (us, te_bits, sig95): mean, significant windows and peak before and from a boundary on, and the last significant time."""
    before = F.col("us") < boundary_us
    v = lambda c: F.when(c, F.col("te_bits"))
    return df.groupBy(*keys).agg(
        F.avg(v(before)).alias("mean_before"), F.avg(v(~before)).alias("mean_after"), F.count_if(before & F.col("sig95")).alias("sig_before"), F.count_if(~before & F.col("sig95")).alias("sig_after"),
        F.max(v(before)).alias("peak_before"), F.max(v(~before)).alias("peak_after"), F.max(F.when(F.col("sig95"), F.col("us"))).alias("last_sig_us"),
    )


def history_sensitivity(te: DataFrame, window_points: int, keys: Sequence[str] = ("target", "entity"), order: str = "window_idx", dims: int = 2) -> DataFrame:
    """By key and history length: descriptors of te_bits, and against length 1 the ratio of means, rank correlation and top-decile overlap.

    joint_dim is the number of estimated dimensions, n_min = 3 * 2 ** joint_dim the points it asks for.
    """
    own = [*keys, "history"]
    te = materialize(te, "sweep")
    s = te.groupBy(*own).agg(F.avg("te_bits").alias("mean"), half("te_bits").alias("median"), F.stddev_pop("te_bits").alias("std"), F.max("te_bits").alias("max"))
    one = te.where("history = 1").select(*keys, order, F.col("te_bits").alias("first"))
    both = te.join(one, [*keys, order])
    base = s.where("history = 1").select(*keys, F.col("mean").alias("_m"))
    dim = F.col("history") + F.lit(dims)
    out = s.join(base, list(keys)).join(spearman(both, "te_bits", "first", own), own).join(top_jaccard(both, "te_bits", "first", 0.9, own), own)
    out = out.withColumns({"ratio": F.col("mean") / F.nullif(F.col("_m"), F.lit(0.0)), "joint_dim": dim.cast("long"), "n_min": (3 * F.pow(F.lit(2.0), dim)).cast("long")})
    return out.withColumn("undersampled", F.col("n_min") > window_points).drop("_m")


def scale_recovery(df: DataFrame, scaled: str, z: str, keys: Sequence[str] = ()) -> DataFrame:
    """The factor between two columns: the median of their ratio, and the spread of it over rows."""
    r = F.col(scaled) / F.col(z)
    return df.where(F.col(z) != 0).groupBy(*keys).agg(half(r).alias("factor"), F.stddev_pop(r).alias("spread"))


def mean_coverage(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """One row: the mean over keys of the share of rows that have a value."""
    return df.groupBy(*keys).agg((F.count(value) / F.count(F.lit(1))).alias("c")).agg(F.avg("c").alias("coverage"))


def mismatched_rows(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """One row: how many values of `on` stand in only one of the tables."""
    left, right = a.select(on, F.lit(True).alias("_a")), b.select(on, F.lit(True).alias("_b"))
    return left.join(right, on, "full").agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("mismatches"))


def circle_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Centre and radius of the algebraic least-squares circle, in closed form from sums about the mean."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    d = (df.join(m, list(keys)) if keys else df.join(F.broadcast(m))).withColumns({"_u": F.col(x) - F.col("_mx"), "_v": F.col(y) - F.col("_my")})
    u, v = F.col("_u"), F.col("_v")
    s = d.groupBy(*keys, "_mx", "_my").agg(F.avg(u * u).alias("uu"), F.avg(v * v).alias("vv"), F.avg(u * v).alias("uv"), F.avg(u * (u * u + v * v)).alias("a"), F.avg(v * (u * u + v * v)).alias("b"))
    det = F.nullif(2 * (F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")), F.lit(0.0))
    cu, cv = (F.col("a") * F.col("vv") - F.col("b") * F.col("uv")) / det, (F.col("b") * F.col("uu") - F.col("a") * F.col("uv")) / det
    return s.select(*keys, (F.col("_mx") + cu).alias("cx"), (F.col("_my") + cv).alias("cy"), F.sqrt(cu * cu + cv * cv + F.col("uu") + F.col("vv")).alias("radius"))


def block_length(df: DataFrame, keys: Sequence[str], value: str = "value", order: str = "idx", most: int = 200) -> DataFrame:
    """First lag at which the autocorrelation of each key's series is below 1/e, else a tenth of its length; from 2 to a third of it.

    All lags count. Those up to `most` are examined first, each row meeting that many others, and further ones in ranges
    that double, for series that aren't below 1/e by then.
    """
    at = F.col(order)
    n = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"), (F.max(at) - F.min(at)).alias("_span"))
    c = df.join(n, list(keys)).select(*keys, at.alias("_i"), (F.col(value) - F.col("_m")).alias("_c"), "_n", "_span")

    def sums(rows: DataFrame, low: int, high: int) -> DataFrame:
        ahead = rows.select(*keys, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag"), "_i", "_c").withColumn("_i", F.col("_i") - F.col("lag")).withColumnRenamed("_c", "_d")
        return rows.join(ahead, [*keys, "_i"]).groupBy(*keys, "_n", "_span", "lag").agg(F.sum(F.col("_c") * F.col("_d")).alias("_s"))

    def first_below(acf: DataFrame, zero: DataFrame) -> DataFrame:
        below = F.when((F.col("lag") > 0) & (F.col("_s") / F.nullif(F.col("_z"), F.lit(0.0)) < F.exp(F.lit(-1.0))), F.col("lag"))
        return acf.join(zero, list(keys)).groupBy(*keys, "_n", "_span", "_z").agg(F.min(below).alias("_l"))

    acf, high = sums(c, 0, most), most
    low = first_below(acf, acf.where("lag = 0").select(*keys, F.col("_s").alias("_z"))).persist()
    settled = []
    while True:
        waits = F.coalesce(F.col("_l").isNull() & (F.col("_z") > 0) & (F.col("_span") > high), F.lit(False))
        left = low.where(waits)
        if left.isEmpty():
            break
        settled.append(low.where(~waits))
        found = first_below(sums(c.join(left.select(*keys), list(keys)), high + 1, 2 * high), left.select(*keys, "_z"))
        low, high = left.drop("_l").join(found.select(*keys, "_l"), list(keys), "left").persist(), 2 * high
    for other in settled:
        low = low.unionByName(other)
    size = F.greatest(F.lit(2), F.least(F.coalesce("_l", F.floor(F.col("_n") / 10)), F.floor(F.col("_n") / 3)))
    return low.select(*keys, F.when(F.col("_z") > 0, size).otherwise(2).cast("long").alias("block"))


def sublimation_mm_day(latent_heat: Column) -> Column:
    """Millimetres of water a day from a latent heat flux in W/m2 (2.838e6 J/kg)."""
    return latent_heat / F.lit(2.838e6) * 86400
