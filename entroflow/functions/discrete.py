"""Plug-in entropies of discrete columns: one aggregation by value, then sums over the counts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of_counts(n: Column, total: Column, base: float) -> Column:
    p = n / total
    return F.sum(-p * F.ln(p)) / F.lit(float(math.log(base)))


def entropies(df: DataFrame, sets: Sequence[Sequence[str]], base: float = 2) -> DataFrame:
    """One row with h0, h1, ..: the joint entropy of each set of columns, in one pass by grouping sets; nulls are a value.

    totals has one row a set, so it is safe to broadcast.
    """
    names = sorted(set(chain.from_iterable(sets)))
    distinct = sorted({tuple(sorted(set(s))) for s in sets})
    code = lambda s: sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in s)
    counts = df.groupingSets([[F.col(c) for c in s] for s in distinct], *[F.col(c) for c in names]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    totals = counts.groupBy("g").agg(F.sum("n").alias("total"))
    h = counts.join(F.broadcast(totals), "g").groupBy("g").agg(_of_counts(F.col("n"), F.col("total"), base).alias("h"))
    return h.groupBy().agg(*[F.max(F.when(F.col("g") == code(s), F.col("h"))).alias(f"h{i}") for i, s in enumerate(sets)])


def _combine(df: DataFrame, terms: Sequence[tuple[int, Sequence[str]]], name: str, base: float) -> DataFrame:
    h = entropies(df, [s for _, s in terms], base)
    return h.select(reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"h{i}") for i, (w, _) in enumerate(terms)]).alias(name))


def entropy(df: DataFrame, x: Sequence[str], base: float = 2) -> DataFrame:
    return _combine(df, [(1, x)], "h", base)


def conditional_entropy(df: DataFrame, x: Sequence[str], y: Sequence[str], base: float = 2) -> DataFrame:
    return _combine(df, [(1, [*x, *y]), (-1, y)], "h", base)


def mutual_information(df: DataFrame, x: Sequence[str], y: Sequence[str], base: float = 2) -> DataFrame:
    return _combine(df, [(1, x), (1, y), (-1, [*x, *y])], "mi", base)


def conditional_mutual_information(df: DataFrame, x: Sequence[str], y: Sequence[str], z: Sequence[str], base: float = 2) -> DataFrame:
    return _combine(df, [(1, [*x, *z]), (1, [*y, *z]), (-1, [*x, *y, *z]), (-1, z)], "cmi", base)


def total_correlation(df: DataFrame, xs: Sequence[str], base: float = 2) -> DataFrame:
    return _combine(df, [*((1, [c]) for c in xs), (-1, xs)], "tc", base)


def conditional_total_correlation(df: DataFrame, xs: Sequence[str], y: Sequence[str], base: float = 2) -> DataFrame:
    terms = [t for c in xs for t in ((1, [c, *y]), (-1, y))]
    return _combine(df, [*terms, (-1, [*xs, *y]), (1, y)], "ctc", base)


def explained_correlation(df: DataFrame, xs: Sequence[str], y: Sequence[str], base: float = 2) -> DataFrame:
    """Total correlation of xs less that given y."""
    tc = [*((1, [c]) for c in xs), (-1, xs)]
    ctc = [t for c in xs for t in ((-1, [c, *y]), (1, y))]
    return _combine(df, [*tc, *ctc, (1, [*xs, *y]), (-1, y)], "corex", base)


def entropy_by(df: DataFrame, keys: Sequence[str], x: Sequence[str], name: str = "h") -> DataFrame:
    """keys and the entropy in bits of the columns x together, by key."""
    n = df.groupBy(*keys, *x).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg((F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias(name))
