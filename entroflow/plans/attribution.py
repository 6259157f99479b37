"""From per-window results to statements: categories, winners, combination statistics, shortlists and period attribution.

Facts are long: entity (or combo), idx or us, value. Nothing is pivoted; periods and targets are small dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import stats
from ..sources.scratch import materialize

CATEGORIES = ("synergistic", "redundant", "obfuscating")


def categorised(s: DataFrame) -> DataFrame:
    """Rows with jte_bits, sum_te and max_te, with category and plotted_value.

    Above the sum is synergistic, under the best single source obfuscating, between them redundant; an obfuscating
    combination shows its best single source, the others their joint value.
    """
    c = F.when(F.col("jte_bits") > F.col("sum_te"), "synergistic").when(F.col("jte_bits") < F.col("max_te"), "obfuscating").otherwise("redundant")
    return s.withColumn("category", c).withColumn("plotted_value", F.when(F.col("category") == "obfuscating", F.col("max_te")).otherwise(F.col("jte_bits")))


def winners(df: DataFrame, keys: Sequence[str], entity: str = "entity", value: str = "plotted_value") -> DataFrame:
    """The entity of the largest value for each key (window), by name where equal."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value), entity)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def win_shares(won: DataFrame, window: str = "window_idx", entity: str = "entity") -> DataFrame:
    n = won.agg(F.countDistinct(window).alias("_n"))
    return won.groupBy(entity).agg(F.count(F.lit(1)).alias("wins")).join(F.broadcast(n)).select(entity, "wins", (F.col("wins") / F.col("_n")).alias("win_share"))


def envelope(df: DataFrame, keys: Sequence[str], value: str = "plotted_value") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias("value"))


def synergy_gain(s: DataFrame, entity: str = "entity") -> DataFrame:
    """Mean of joint value less the best single source."""
    return s.groupBy(entity).agg(F.avg(F.col("jte_bits") - F.col("max_te")).alias("gain"))


def combo_table(df: DataFrame, active: DataFrame, won: DataFrame, order: str = "window_idx") -> DataFrame:
    """One row a combination: descriptors of plotted_value, category shares, win share, gain and episode alignment.

    df: entity, window_idx, jte_bits, max_te, plotted_value, category; active: window_idx, active (the target's
    episodes); won: the winners of df.
    """
    parts = [
        stats.series_stats(df, ["entity"], "plotted_value", order),
        stats.category_fractions(df, ["entity"], "category", CATEGORIES, order),
        win_shares(won, order),
        synergy_gain(df),
        stats.episode_alignment(df.join(active, order), ["entity"], "plotted_value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "entity", "left")
    return out.withColumns({"wins": F.coalesce("wins", F.lit(0).cast("long")), "win_share": F.coalesce("win_share", F.lit(0.0))})


LENSES = {"persistent": "mean", "episodic": "cv", "synergistic": "gain", "masked": "frac_obfuscating", "switching": "n_flips", "episode_aligned": "alignment"}


def shortlist(table: DataFrame, top: int = 8) -> DataFrame:
    """The top combinations of each lens among those whose peak is at least the median peak, with their reasons."""
    strong = table.join(F.broadcast(table.agg(stats.half("peak").alias("_floor")))).where(F.col("peak") >= F.col("_floor")).drop("_floor")
    strong = materialize(strong, "strong")  # one row a combination, read once for each lens
    out = None
    for reason, column in LENSES.items():
        part = strong.where(F.col(column).isNotNull()).orderBy(F.desc(column), "entity").limit(top).select("entity", F.lit(reason).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons"))


def layers(df: DataFrame, n: int, value: str = "value", order: str = "idx", entity: str = "entity") -> DataFrame:
    """df with baseline (centred rolling median of n windows) and excess."""
    return stats.excess(stats.rolling_median(df, [entity], n, value, order), value)


def burst_mask(df: DataFrame, least: int = 3, max_gap: int = 2, entity: str = "entity", value: str = "value", order: str = "idx") -> DataFrame:
    """df (value, excess, floor_pct) with active: excess positive and value at least the floor, short dips bridged, short runs dropped."""
    above = (F.col("excess") > 0) & (F.col(value) >= F.col("floor_pct"))
    return stats.long_runs(stats.bridged(df, above, [entity], max_gap, order=order), [entity], least, order).drop("run")


def in_periods(df: DataFrame, periods: DataFrame, us: str = "us") -> DataFrame:
    """Rows with the periods (period, start, end in microseconds, both inclusive) that hold them; periods are a small dimension."""
    return df.join(F.broadcast(periods), F.col(us).between(F.col("start"), F.col("end"))).drop("start", "end")


def audit(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Every period and entity: mean value, mean baseline, excess summed over bursts."""
    return in_periods(df, periods).groupBy("period", "entity").agg(
        F.round(F.avg("value"), 3).alias("mean_pct"), F.round(F.avg("baseline"), 3).alias("baseline_pct"), F.round(F.sum(F.when(F.col("active"), F.col("excess")).otherwise(0.0)), 3).alias("burst_pct")
    )


def episodic_slot(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Each period's entity of most excess within bursts, with its windows, peak and the peak's first time."""
    d = in_periods(df, periods).where("active")
    s = d.groupBy("period", "entity").agg(F.sum("excess").alias("integrated"), F.count(F.lit(1)).alias("windows"), F.max("value").alias("peak"), F.max_by("us", F.struct(F.col("value"), -F.col("us"))).alias("peak_us"))
    w = Window.partitionBy("period").orderBy(F.desc("integrated"), "entity")
    return s.where("integrated > 0").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def period_scores(df: DataFrame, periods: DataFrame) -> DataFrame:
    """(period, entity, bases, score, floor, gain): mean value, mean floor, and for combinations the lead over the best proper subset of their bases."""
    d = in_periods(df, periods)
    floor = d.select("period", "us", "floor_pct").distinct().groupBy("period").agg(F.avg("floor_pct").alias("floor"))
    bases = F.array_sort(F.transform(F.split("entity", r"\+"), lambda p: F.regexp_extract(p, r"^(.*)__t\d+$", 1)))
    s = d.groupBy("period", "entity").agg(F.avg("value").alias("score")).where("score IS NOT NULL").withColumn("bases", bases)
    best = s.groupBy("period", "bases").agg(F.max("score").alias("best"))
    # A set of up to three bases has at most six proper subsets.
    n = F.size("bases")
    masks = s.where(n > 1).select("period", "entity", F.explode(F.expr("filter(transform(sequence(1, 6), m -> filter(bases, (b, i) -> (shiftright(m, i) & 1) = 1)), q -> size(q) > 0 AND size(q) < size(bases))")).alias("bases")).distinct()
    sub = masks.join(best, ["period", "bases"]).groupBy("period", "entity").agg(F.max("best").alias("_best"))
    return s.join(sub, ["period", "entity"], "left").join(F.broadcast(floor), "period").select("period", "entity", "bases", "score", "floor", F.when(n > 1, F.col("score") - F.coalesce("_best", F.lit(float("-inf")))).alias("gain"))


def pick_winners(scores: DataFrame, delta_fraction: float = 0.5, most: int = 3, runner: float = 0.6) -> DataFrame:
    """The period's winners in order of score: over the floor, near the first, base-disjoint, combinations justified by their gain.

    Candidates are cut first (floor, runner share, gain). Then a slot is filled in every period at once: the best of what is
    left wins, and whatever shares a base with it leaves. Each slot is a partial aggregation and a join by period, so a period
    may have any number of candidates. Rows without a period are left out; equal scores go by entity.
    """
    w = Window.partitionBy("period").orderBy(F.desc("score"), "entity")
    ranked = scores.where("period IS NOT NULL").withColumn("raw_rank", F.row_number().over(w))
    # The first winner is the best that passes; nothing under the runner share of it can be picked later.
    passing = ranked.where((F.col("score") >= F.col("floor")) & (F.col("gain").isNull() | (F.col("gain") >= F.lit(delta_fraction) * F.col("floor"))))
    passing = materialize(passing.select("period", "entity", "bases", "score", "gain", "raw_rank", "floor"), "candidates")
    top = passing.groupBy("period").agg(F.max("score").alias("_top"))
    left = passing.join(top, "period").where(F.col("score") >= F.lit(runner) * F.col("_top")).drop("_top")
    slots = []
    for slot in range(1, most + 1):
        best = left.groupBy("period").agg(F.min_by(F.struct("entity", "bases", "score", "gain", "raw_rank", "floor"), "raw_rank").alias("best"))
        best = materialize(best.select("period", F.lit(slot).alias("slot"), "best.*"), "winners")
        slots.append(best)
        taken = best.select("period", F.col("bases").alias("_taken"))
        left = left.join(taken, "period").where(~F.coalesce(F.arrays_overlap("bases", "_taken"), F.lit(False))).drop("_taken")
    picked = slots[0]
    for more in slots[1:]:
        picked = picked.unionByName(more)
    return picked.select("period", "slot", "entity", "score", "gain", "raw_rank", "floor")


def statements(rows: Iterator) -> list[str]:
    """Lines of a report on collected winners."""
    return [f"{r['period']} #{r['slot']}: {r['entity']} ({r['score']:.3f} %)" for r in rows]


def unified(combos: DataFrame, singles: DataFrame, entropy: DataFrame, on: str, before: int | None = None) -> DataFrame:
    """Frames of combinations and single entities (entity, on, bits) as one, up to a cutoff, in per cent of the target's entropy h."""
    both = combos.unionByName(singles)
    rows = both if before is None else both.where(F.col(on) < before)
    return rows.join(entropy, on).withColumn("pct_h", stats.percent_of(F.col("bits"), F.col("h")))


def noise_floor(bits: Column, h: Column) -> Column:
    """A floor in bits in per cent of the entropy."""
    return stats.percent_of(bits, h)


def attributed(df: DataFrame, periods: DataFrame) -> DataFrame:
    """A row a period and entity: score, baseline, excess within bursts, floor, whether the score reaches it, and the rank of the score."""
    s = in_periods(df, periods).groupBy("period", "entity").agg(
        F.avg("value").alias("score"), F.avg("baseline").alias("baseline"), F.sum(F.when(F.col("active"), F.col("excess")).otherwise(0.0)).alias("burst"), F.avg("floor_pct").alias("floor")
    )
    w = Window.partitionBy("period").orderBy(F.desc(F.round("score", 6)), "entity")
    return s.withColumns({"over_floor": F.col("score") >= F.col("floor"), "raw_rank": F.row_number().over(w).cast("long")})


def integrated(df: DataFrame, order: str, entity: str = "entity") -> DataFrame:
    """By entity: excess summed over bursts, the peak and its first place."""
    first = F.max_by(order, F.struct(F.col("value"), -F.col(order)))
    return df.groupBy(entity).agg(F.sum(F.when(F.col("active"), F.col("excess"))).alias("integrated"), F.max("value").alias("peak"), first.alias("peak_at"))


def panels(table: DataFrame, top: int = 4) -> DataFrame:
    """(entity, panel): the top entities by mean are persistent; of the others, the top ones by variation are episodic."""
    persistent = table.orderBy(F.desc("mean"), "entity").limit(top).select("entity")
    episodic = table.join(F.broadcast(persistent), "entity", "left_anti").orderBy(F.desc("cv"), "entity").limit(top).select("entity")
    return persistent.withColumn("panel", F.lit("persistent")).unionByName(episodic.withColumn("panel", F.lit("episodic")))


def selection_index(df: DataFrame, value: str = "plotted_value") -> DataFrame:
    """entity, mean, peak and place by mean, one row a drawn entity."""
    s = df.groupBy("entity").agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("peak"))
    # As many rows as entities are drawn.
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "entity")).cast("long"))


def fallback_curve(df: DataFrame, stored: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """entity, order, curve, source: the stored baseline of entities that have one, else the centred rolling median of n values."""
    smooth = stats.rolling_median(df, ["entity"], n, "value", order)
    there = stored.select("entity").distinct().withColumn("_has", F.lit(True))
    rows = smooth.drop("value").withColumnRenamed("baseline", "_smooth").join(stored, ["entity", order], "left").join(F.broadcast(there), "entity", "left")
    has = F.coalesce("_has", F.lit(False))
    return rows.select("entity", order, F.when(has, F.col("baseline")).otherwise(F.col("_smooth")).alias("curve"), F.when(has, "baseline").otherwise("smoothed").alias("source"))
