"""Exact ranks and quantiles of keys of any size, by ranges of values.

Equal values are counted first, so the work is on distinct values; these are dealt by ranges of (key, value), which no
key's share of the rows makes uneven. Ranges know how many rows lie before them from the totals of the ranges ahead of
them, one row a range and key. So no task holds a key's values, and ties never cross a border.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .scan import same

#: Rows of a key up to which a task may hold its values, and rows of a range.
HELD, RANGE = 1_000_000, 200_000


def ranges(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n (rows that have it) and _range, as a table: ranges of about RANGE distinct values follow one another."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    parts = max(1, -(-counts.count() // RANGE))
    # Written once, so that a range is the same set of rows whenever it is read.
    return materialize(counts.repartitionByRange(parts, *[F.col(c) for c in keys], F.col(value)).withColumn("_range", F.spark_partition_id()), "ranges")


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n, ahead (rows of the key with smaller values); nulls are left out, not-a-number comes last."""
    dealt = ranges(df, keys, value)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda w: F.coalesce(F.sum("n").over(before(w)), F.lit(0))
    totals = dealt.groupBy(*keys, "_range").agg(F.sum("n").alias("n"))
    totals = totals.select(*keys, "_range", sums(Window.partitionBy(*keys).orderBy("_range")).alias("_ahead"))
    local = dealt.withColumn("ahead", sums(Window.partitionBy(*keys, "_range").orderBy(value)))
    return same(local, totals, [*keys, "_range"]).withColumn("ahead", F.col("ahead") + F.col("_ahead")).drop("_range", "_ahead")


def with_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """df with the average rank of its value from 1 on: null for nulls. Rows meet their value's rank, hot values by salted parts."""
    salts = 16
    v = ranked_values(df, keys, value).select(*keys, value, (F.col("ahead") + (F.col("n") + 1) / 2).alias(name))
    spread = v.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return same(df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")), spread, [*keys, value, "_salt"], "left").drop("_salt")


def of_ranked(v: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """keys and, for each name, the quantile of ranked_values with linear interpolation between neighbours."""
    n = v.groupBy(*keys).agg(F.sum("n").alias("_n"))
    place = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    d = same(v, n, keys)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("ahead") <= rank) & (rank < F.col("ahead") + F.col("n")), F.col(value).cast("double")))

    found = d.groupBy(*keys).agg(F.max("_n").alias("_n"), *[c for name, p in probs.items() for c in (at(F.floor(place(p))).alias(f"_lo_{name}"), at(F.ceil(place(p))).alias(f"_hi_{name}"))])
    line = lambda name, p: F.col(f"_lo_{name}") + (place(p) - F.floor(place(p))) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
    return found.select(*keys, *[line(name, p).alias(name) for name, p in probs.items()])


def small(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every key has at most HELD rows."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) <= HELD


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], held: bool | None = None) -> DataFrame:
    """keys and the named quantiles of their values; null where a key has none.

    Keys of up to HELD rows are worked out in one aggregation, any other by ranges of values: the same quantiles. held: the
    answer of small(df, keys), where it is known.
    """
    every = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if small(df, keys) if held is None else held:
        return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(float(p))).alias(name) for name, p in probs.items()])
    return same(every.drop("_n"), of_ranked(ranked_values(df, keys, value), keys, value, probs), keys, "left") if keys else of_ranked(ranked_values(df, keys, value), keys, value, probs)


def rank_sums(df: DataFrame, keys: Sequence[str], value: str, name: str, held: bool | None = None) -> DataFrame:
    """keys and the sum of their values, each times its place from 1 on in ascending order; nulls are left out, equal values share their places' sum."""
    if small(df, keys) if held is None else held:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(value)).cast("long")
        return df.where(F.col(value).isNotNull()).withColumn("_place", place).groupBy(*keys).agg(F.sum(F.col("_place") * F.col(value)).alias(name))
    n = F.col("n").cast("double")
    return ranked_values(df, keys, value).groupBy(*keys).agg(F.sum(F.col(value) * (n * F.col("ahead") + n * (n + 1) / 2)).alias(name))
