"""Rolling transfer entropy, joint transfer entropy and entropy over a uniform grid.

Rows of a wide grid table (idx, us, variables) are dealt to overlapping blocks of window centres by arithmetic on idx:
no sort of the whole series, no frame per row. A block with its halo, a chunk of entities and, for surrogates, a round of
replicates are a unit: a bounded group that array kernels turn into results. Units are dealt by their number of
evaluations over a stated number of partitions. Windows hold the rows [centre - half, centre + half); window_idx
counts from the first full one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import knn, surrogates
from ..sources.series import require_columns
from . import dealing
from .catalog import Entity, component_columns

BLOCK, CHUNK, ROUND = 32, 4, 50


def _dealt(grid: DataFrame, names: Sequence[str], half: int, keys: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, entities: int = 1, replicates: int = 1, only: DataFrame | None = None) -> DataFrame:
    """run on every unit (block of a series, _chunk of entities, _round of replicates): its rows by idx, with the first and last idx of their series.

    only (entity_no, centre), for a grid without keys: units without one of these windows are left out, the others' rows
    have those of their unit as _todo.
    """
    require_columns(grid, [*keys, "idx", "us", *names])
    ends = grid.groupBy(*keys).agg(F.min("idx").alias("_first"), F.max("idx").alias("_last"))
    size = ends.select(F.greatest(F.col("_last") - F.col("_first") - 2 * half + 1, F.lit(0)).alias("n")).agg(F.sum("n").alias("n"), F.sum(F.ceil(F.col("n") / BLOCK) + 1).alias("blocks")).first()
    windows, blocks = size["n"] or 0, size["blocks"] or 0
    chunks, rounds = -(-entities // CHUNK), -(-replicates // ROUND)
    work = windows * entities * replicates
    parts = dealing.partitions(grid.sparkSession, work, blocks * chunks * rounds)

    rows = grid.select(*keys, "idx", "us", *[F.col(c).cast("double") for c in dict.fromkeys(names)])
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    rows = rows.join(ends.withColumnsRenamed({c: f"_of_{c}" for c in keys}), on).drop(*[f"_of_{c}" for c in keys]) if keys else rows.join(F.broadcast(ends))
    lo, hi = F.floor((F.col("idx") - half + 1) / BLOCK), F.floor((F.col("idx") + half) / BLOCK)
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("_block", F.explode(F.sequence(lo, hi))).withColumn("_chunk", whole(chunks)).withColumn("_round", whole(rounds))
    if only is not None:
        # At most BLOCK x CHUNK windows a unit.
        unit = only.groupBy(F.floor(F.col("centre") / BLOCK).alias("_block"), F.floor(F.col("entity_no") / CHUNK).cast("int").alias("_chunk"))
        rows = rows.join(unit.agg(F.collect_list(F.struct("entity_no", "centre")).alias("_todo")), ["_block", "_chunk"])
    first, last = F.col("_first") + half, F.col("_last") - half
    begin = F.greatest(F.col("_block") * BLOCK, first)
    own = F.least((F.col("_block") + 1) * BLOCK - 1, last) - begin + 1
    in_chunk = F.least(F.lit(CHUNK), entities - F.col("_chunk") * CHUNK)
    before = (begin - first) * entities * replicates + own * (F.col("_chunk") * CHUNK * replicates + in_chunk * F.col("_round") * ROUND)
    return dealing.by_unit(rows.where(own > 0), [*keys, "_block", "_chunk", "_round"], "idx", before, float(work), parts, run, schema, keys)


def _windows(g: pd.DataFrame, half: int):
    """(centre idx, centre us, slice) of the full windows whose centre lies in the group's block."""
    block, first, last = int(g["_block"].iloc[0]), int(g["_first"].iloc[0]), int(g["_last"].iloc[0])
    at = g["idx"].to_numpy()
    for c in range(max(block * BLOCK, first + half), min((block + 1) * BLOCK - 1, last - half) + 1):
        lo = int(np.searchsorted(at, c - half))
        if lo + 2 * half <= len(at) and at[lo] == c - half:
            yield c, int(g["us"].iloc[lo + half]), slice(lo, lo + 2 * half), c - first - half


def _arrays(g: pd.DataFrame, e: Entity, columns: Mapping[str, Sequence[str]]) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
    return [g[list(columns[b])].to_numpy(float) for b, _ in e.sources], g[e.target].to_numpy(float), [t for _, t in e.sources]


def _setup(entities: Sequence[Entity], vector_bases) -> tuple[list[Entity], dict[str, list[str]], list[str]]:
    own = [e for e in entities if e.target not in {b for b, _ in e.sources}]
    if not own:
        raise ValueError("no entity, or only targets as their own source")
    columns = component_columns([b for e in own for b, _ in e.sources], vector_bases)
    return own, columns, [*(c for v in columns.values() for c in v), *(e.target for e in own)]


def rolling_te(grid: DataFrame, entities: Sequence[Entity], window_points: int, k: int = 3, keys: Sequence[str] = (), vector_bases: Mapping[str, Sequence[str]] | None = None, only: DataFrame | None = None) -> DataFrame:
    """Transfer entropy of each entity (joint with several sources) in each window, or in those of `only` (entity_no, centre).

    Returns keys, target, entity, history, window_idx, us, te_raw, te_bits (0 if negative), status. An entity whose target is among
    its sources is left out; keys tell several grids apart.
    """
    own, columns, names = _setup(entities, vector_bases)
    half = window_points // 2
    limited = only is not None

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        begin = int(g["_chunk"].iloc[0]) * CHUNK
        todo = {(t["entity_no"], t["centre"]) for t in g["_todo"].iloc[0]} if limited else None
        for i, e in enumerate(own[begin : begin + CHUNK], begin):
            xs, y, taus = _arrays(g, e, columns)
            for c, us, rows, w in _windows(g, half):
                if todo is not None and (i, c) not in todo:
                    continue
                raw, status = knn.transfer_entropy([x[rows] for x in xs], y[rows], taus, e.history, k)
                out.append((*(g[n].iloc[0] for n in keys), e.target, e.name, e.history, w, us, raw, max(raw, 0.0), status))
        return pd.DataFrame(out, columns=[*keys, "target", "entity", "history", "window_idx", "us", "te_raw", "te_bits", "status"])

    kinds = "".join(f"{c} {grid.schema[c].dataType.simpleString()}, " for c in keys)
    schema = f"{kinds}target string, entity string, history int, window_idx long, us long, te_raw double, te_bits double, status string"
    return _dealt(grid, names, half, keys, run, schema, len(own), only=only)


def rolling_entropy(grid: DataFrame, targets: Sequence[str], window_points: int, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Entropy of each target in each window: keys, target, window_idx, us, h_bits."""
    half = window_points // 2

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = [(*(g[c].iloc[0] for c in keys), t, w, us, knn.window_entropy(v[rows], k)) for t in targets for v in [g[t].to_numpy(float)] for _, us, rows, w in _windows(g, half)]
        return pd.DataFrame(out, columns=[*keys, "target", "window_idx", "us", "h_bits"])

    kinds = "".join(f"{c} {grid.schema[c].dataType.simpleString()}, " for c in keys)
    return _dealt(grid, targets, half, keys, run, f"{kinds}target string, window_idx long, us long, h_bits double")


def synergy(te: DataFrame, keys: Sequence[str] = ("target", "history")) -> DataFrame:
    """Joint rows with sum_te and max_te of their single sources, synergy = joint - sum, and a label by 0.001 bits."""
    single = te.where(~F.col("entity").contains("+")).select(*keys, "window_idx", F.col("entity").alias("member"), F.col("te_bits").alias("member_bits"))
    joint = te.where(F.col("entity").contains("+")).withColumnRenamed("te_bits", "jte_bits")
    parts = joint.select(*keys, "window_idx", "us", "entity", "jte_bits", F.explode(F.split("entity", r"\+")).alias("member"))
    s = parts.join(single, [*keys, "window_idx", "member"]).groupBy(*keys, "window_idx", "us", "entity", "jte_bits").agg(F.sum("member_bits").alias("sum_te"), F.max("member_bits").alias("max_te"))
    diff = F.col("jte_bits") - F.col("sum_te")
    return s.withColumns({"synergy": diff, "label": F.when(diff > 0.001, "SYNERGISTIC").when(diff < -0.001, "REDUNDANT").otherwise("INDEPENDENT")})


def synergy_stats(s: DataFrame, keys: Sequence[str] = ("target", "entity")) -> DataFrame:
    """Per entity: mean joint, mean sum, mean synergy, its share of the joint, and per cent of windows above and below 0."""
    return s.groupBy(*keys).agg(
        F.avg("jte_bits").alias("mean_jte"), F.avg("sum_te").alias("mean_sum_te"), F.avg("synergy").alias("mean_synergy"), (F.avg("synergy") / F.nullif(F.avg("jte_bits"), F.lit(0.0))).alias("synergy_fraction"),
        (F.avg((F.col("synergy") > 0).cast("double")) * 100).alias("pct_synergistic"), (F.avg((F.col("synergy") < 0).cast("double")) * 100).alias("pct_redundant"),
    )


def surrogate_te(grid: DataFrame, entities: Sequence[Entity], window_points: int, n_surrogates: int, kind: str = "iaaft", k: int = 3, seed: int = 0, vector_bases: Mapping[str, Sequence[str]] | None = None, digests: bool = False) -> DataFrame:
    """Transfer entropy on surrogate sources: target, entity, window_idx, us, replicate, te_bits (0 if negative).

    Each source has its own surrogate; a vector source's components share theirs. A replicate's generator is seeded by
    (seed, entity, window, replicate), so a result doesn't depend on how the work is dealt. digests: permutations follow digests
    of "seed:entity > target:window:replicate" (surrogates.DigestOrder), for kinds that only permute.
    """
    if digests and kind not in surrogates.PERMUTING:
        raise ValueError(f"digests give permutations, which {kind!r} isn't made by")
    own, columns, names = _setup(entities, vector_bases)
    half = window_points // 2

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first = int(g["_round"].iloc[0]) * ROUND
        drawn = range(first, min(first + ROUND, n_surrogates))
        out = []
        for e in own[int(g["_chunk"].iloc[0]) * CHUNK :][:CHUNK]:
            xs, y, taus = _arrays(g, e, columns)
            mark = zlib.crc32(f"{e.target}<{e.name}".encode())
            for _, us, rows, w in _windows(g, half):
                rngs = [surrogates.DigestOrder(f"{seed}:{e.name} > {e.target}:{w}:{r}") if digests else np.random.default_rng([seed, mark, w, r]) for r in drawn]
                fake = [surrogates.replicates(x[rows], kind, rngs) for x in xs]
                te = np.maximum(knn.transfer_entropies(fake, y[rows], taus, e.history, k), 0.0)
                out.append(pd.DataFrame({"target": e.target, "entity": e.name, "window_idx": w, "us": us, "replicate": np.arange(first, first + len(te), dtype=np.int32), "te_bits": te}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["target", "entity", "window_idx", "us", "replicate", "te_bits"])

    return _dealt(grid, names, half, (), run, "target string, entity string, window_idx long, us long, replicate int, te_bits double", len(own), n_surrogates)


def surrogate_series(grid: DataFrame, bases: Sequence[str], window_points: int, n_surrogates: int, kind: str = "iaaft", seed: int = 0, vector_bases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The surrogates themselves: base, window_idx, replicate, at (place in the window), column, value (null in a gap).

    A base's components, if it is a vector, are drawn together; generators are seeded by (seed, base, window, replicate).
    """
    columns = component_columns(bases, vector_bases)
    half = window_points // 2

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first = int(g["_round"].iloc[0]) * ROUND
        drawn = range(first, min(first + ROUND, n_surrogates))
        out = []
        for b in list(columns)[int(g["_chunk"].iloc[0]) * CHUNK :][:CHUNK]:
            own = g[columns[b]].to_numpy(float)
            for _, _, rows, w in _windows(g, half):
                fake = surrogates.replicates(own[rows], kind, [np.random.default_rng([seed, zlib.crc32(b.encode()), w, r]) for r in drawn])
                r, at, c = (i.ravel() for i in np.indices(fake.shape))
                value = pd.Series(fake.ravel()).astype(object).where(~np.isnan(fake.ravel()), None)
                out.append(pd.DataFrame({"base": b, "window_idx": w, "replicate": r + first, "at": at, "column": np.array(columns[b], object)[c], "value": value}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["base", "window_idx", "replicate", "at", "column", "value"])

    names = list(dict.fromkeys(c for v in columns.values() for c in v))
    return _dealt(grid, names, half, (), run, "base string, window_idx long, replicate long, at long, column string, value double", len(columns), n_surrogates)


def significance(te: DataFrame, replicates: DataFrame, keys: Sequence[str] = ("target", "entity", "window_idx")) -> DataFrame:
    """te with the distribution of its replicates: mean, std (population), thresholds, p value and flags.

    Quantiles lie between sorted values as low + (high - low) x part, as SQL has them to the last digit. The mean of decimal te_bits is exact.
    """
    observed = te.select(*keys, "us", F.col("te_bits").alias("observed"))
    joined = replicates.select(*keys, "te_bits").join(observed, list(keys))
    s = joined.groupBy(*keys, "us", "observed").agg(
        F.count("te_bits").alias("n_valid"), F.avg("te_bits").alias("surr_mean"), F.stddev_pop("te_bits").alias("surr_std"),
        F.avg((F.col("te_bits") >= F.col("observed")).cast("double")).alias("p_value"), F.array_sort(F.collect_list(F.col("te_bits").cast("double"))).alias("_v"),
    )

    def q(p: float) -> Column:
        place = (F.size("_v") - 1) * F.lit(p)
        low, high = (F.get("_v", f(place).cast("int")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    s = s.withColumns({"surr_p95": q(0.95), "surr_p99": q(0.99), "lower_ci": q(0.025), "upper_ci": q(0.975)})
    s = s.select(*keys, "us", F.col("observed").alias("te_bits"), "n_valid", "surr_mean", "surr_std", "surr_p95", "surr_p99", "lower_ci", "upper_ci", "p_value")
    return s.withColumns({"sig95": F.col("te_bits") > F.col("surr_p95"), "sig99": F.col("te_bits") > F.col("surr_p99")})


def stage2(grid: DataFrame, entities: Sequence[Entity], window_points: int, n_surrogates: int = 2000, kind: str = "iaaft", k: int = 3, seed: int = 0, vector_bases: Mapping[str, Sequence[str]] | None = None, digests: bool = False) -> DataFrame:
    """The fixed-entity job: target, entity, window_idx, us, te_bits, error, h_target_bits, pct_h, and the surrogate columns of significance.

    A window that can't be estimated has null te_bits and its status as error. Without surrogates their columns are
    absent; surr_p95_pct is their threshold in per cent of the target's entropy.
    """
    te = rolling_te(grid, entities, window_points, k, vector_bases=vector_bases)
    h = rolling_entropy(grid, list(dict.fromkeys(e.target for e in entities)), window_points, k).withColumnRenamed("h_bits", "h_target_bits").drop("us")
    ok = F.col("status") == "ok"
    share = lambda c: F.when(F.col("h_target_bits") > 0, F.col(c) / F.col("h_target_bits") * 100)
    rows = te.select("target", "entity", "window_idx", "us", F.when(ok, F.col("te_bits")).alias("te_bits"), F.when(~ok, F.col("status")).alias("error"))
    rows = rows.join(h, ["target", "window_idx"], "left").withColumn("pct_h", share("te_bits"))
    if not n_surrogates:
        return rows
    tested = significance(te.where(ok), surrogate_te(grid, entities, window_points, n_surrogates, kind, k, seed, vector_bases, digests)).drop("us", "te_bits")
    return rows.join(tested, ["target", "entity", "window_idx"], "left").withColumn("surr_p95_pct", share("surr_p95"))


def exported(sig: DataFrame, entity: str = "entity") -> DataFrame:
    """sig with `relationship`: its inputs in name order, and the target."""
    return sig.withColumn("relationship", F.concat(F.array_join(F.array_sort(F.split(entity, r"\+")), "+"), F.lit(" -> "), F.col("target")))


def family_level(sig: DataFrame, shown: int | None = None) -> DataFrame:
    """Per target and window, the largest 95 % threshold over its entities; of a target with fewer than `shown` entities in all, none."""
    if shown is not None:
        there = sig.groupBy("target").agg(F.countDistinct("entity").alias("_n")).where(F.col("_n") >= shown).select("target")
        sig = sig.join(F.broadcast(there), "target", "left_semi")
    return sig.groupBy("target", "window_idx", "us").agg(F.max("surr_p95").alias("level"))
