"""Entities: lagged candidates `base__tK`, their combinations, labels, and column maps. Relational where data-sized."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Analysis parameters; out of range values are an error."""

    window_days: float = 30
    history: int = 1
    tau: int = 1
    k: int = 3
    n_surrogates: int = 2000
    significance: float = 0.95
    grid_hours: float = 6
    sigma_fraction: float = 0.25
    max_gap_hours: float = 3
    vector_bases: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def __post_init__(self):
        if self.window_days <= 0 or self.grid_hours <= 0 or self.sigma_fraction <= 0 or self.max_gap_hours < 0:
            raise ValueError("lengths of time must be positive")
        if self.history < 0 or self.tau < 0 or self.k < 1 or self.n_surrogates < 0 or not 0 < self.significance < 1:
            raise ValueError("history, tau and surrogates count from 0, k from 1, significance lies within 0 and 1")


@dataclass(frozen=True)
class Entity:
    """One or more lagged sources of a target."""

    target: str
    sources: tuple[tuple[str, int], ...]
    history: int = 1

    @property
    def name(self) -> str:
        return "+".join(f"{b}__t{t}" for b, t in self.sources)

    @classmethod
    def parse(cls, text: str, target: str, history: int = 1) -> Entity:
        parts = []
        for piece in text.split("+"):
            base, _, tau = piece.rpartition("__t")
            if not base or not tau.isdigit():
                raise ValueError(f"{piece!r} isn't base__tK")
            parts.append((base, int(tau)))
        if len({b for b, _ in parts}) < len(parts):
            raise ValueError(f"{text!r} has a base twice")
        return cls(target, tuple(parts), history)


def component_columns(names: Sequence[str], vector_bases: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """The data columns of each logical name: its own or its vector's components."""
    return {n: list((vector_bases or {}).get(n, [n])) for n in names}


def candidates(spark: SparkSession, groups: Mapping[str, tuple[Sequence[str], Sequence[int]]], excluded: Sequence[str] = ()) -> DataFrame:
    """(grp, base, tau, name) of groups of (bases, taus), without excluded bases."""
    rows = [(g, b, t) for g, (bases, taus) in groups.items() for b in bases for t in taus if b not in excluded]
    return spark.createDataFrame(rows, "grp string, base string, tau int").withColumn("name", F.concat("base", F.lit("__t"), F.col("tau").cast("string")))


def candidates_of(bases: DataFrame, lags: DataFrame, targets: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(target, grp, base, tau, name): each target's candidates from tables of bases (grp, base), lags (grp, tau) and targets.

    A target isn't its own candidate, nor are the bases that `excluded` (target, base) names for it. Repeated rows count once.
    """
    every = bases.select("grp", "base").distinct().join(lags.select("grp", "tau").distinct(), "grp")
    # Targets are few, and each gets all candidates but its own: the size of the result.
    own = targets.select("target").distinct().join(every, F.col("target") != F.col("base"))
    if excluded is not None:
        own = own.join(excluded.select("target", "base"), ["target", "base"], "left_anti")
    return own.select("target", "grp", "base", "tau", F.concat("base", F.lit("__t"), F.col("tau").cast("string")).alias("name"))


def combinations(names: DataFrame, largest: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, entity, bases, n_bases) of all sets of 2 to `largest` candidates (name, base) of a key with distinct bases, in name order."""
    one = names.select(*keys, "name", "base").distinct()
    grown = one.select(*keys, F.array("name").alias("names"), F.array("base").alias("bases"))
    out = None
    for _ in range(largest - 1):
        # A catalogue of candidates, not data: the join on order is its size's own product.
        more = one.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        grown = grown.join(more, [*same, (F.element_at("names", -1) < F.col("name")) & ~F.array_contains("bases", F.col("base"))])
        grown = grown.select(*keys, F.array_append("names", F.col("name")).alias("names"), F.array_append("bases", F.col("base")).alias("bases"))
        out = grown if out is None else out.unionByName(grown)
    return out.select(*keys, F.array_join("names", "+").alias("entity"), F.array_sort("bases").alias("bases"), F.size("bases").cast("long").alias("n_bases"))


def described(df: DataFrame, entity: str = "entity") -> DataFrame:
    """df with kind, n_bases, bases, taus and label of its entity column."""
    parts = F.split(entity, r"\+")
    bases = F.transform(parts, lambda p: F.regexp_extract(p, r"^(.*)__t\d+$", 1))
    taus = F.transform(parts, lambda p: F.regexp_extract(p, r"__t(\d+)$", 1))
    kind = F.element_at(F.array(F.lit("single"), F.lit("pair"), F.lit("triple")), F.size(parts))
    return df.withColumns({"kind": kind, "n_bases": F.size(parts).cast("long"), "bases": F.array_join(bases, ";"), "taus": F.array_join(taus, ";"), "label": label_of(F.col(entity))})


def label_of(entity: Column) -> Column:
    return F.array_join(F.transform(F.split(entity, r"\+"), lambda p: F.concat(F.regexp_extract(p, r"^(.*)__t\d+$", 1), F.lit(" (lag "), F.regexp_extract(p, r"__t(\d+)$", 1), F.lit(")"))), " + ")


def first_seen(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, place): the distinct names by where they occur first."""
    one = df.groupBy(F.col(name).alias("name")).agg(F.min(order).alias("_first"))
    # As many rows as there are names.
    return one.withColumn("place", F.row_number().over(Window.orderBy("_first")).cast("long")).drop("_first")


def with_lag_hours(df: DataFrame, step_hours: int, entity: str = "entity") -> DataFrame:
    """df with the longest lag of its entity in hours."""
    taus = F.transform(F.split(entity, r"\+"), lambda p: F.regexp_extract(p, r"__t(\d+)$", 1).cast("int"))
    return df.withColumn("lag_hours", F.array_max(taus) * step_hours)
