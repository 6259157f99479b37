"""Nearest-neighbour estimators by key, for keys of any size, and the estimators as column functions.

The rows of a key are cut into blocks of about ROWS by a k-d tree that is built on a sample of them and only decides how
much work there is. A block's rows search each other first (functions.near: small leaves, not all pairs); then a row asks those blocks whose box comes
closer than what it has found, or than the distance that it counts within. A box that lies within that distance as
a whole is counted without a comparison. What rows find is merged by row, so results don't depend on the tree.

Equal values: a row whose k-th neighbour is equal to it has distance 0, and the entropy of its key is minus infinity, as
that of any value that holds a share of the rows. jittered() tells equal values apart where they are rounding.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import discrete, knn, near
from ..operators import normalize, ranks
from ..sources.scratch import materialize

ROWS = 50_000
LN2 = float(np.log(2))
Spaces = Mapping[str, Sequence[str]]


def digamma(m: Column) -> Column:
    """Digamma of whole numbers from 1 on: the series at m + 8, less the eight steps back."""
    x = m + F.lit(8.0)
    s = F.log(x) - 1 / (2 * x)
    for c, power in ((-1 / 12, 2), (1 / 120, 4), (-1 / 252, 6), (1 / 240, 8)):
        s = s + F.lit(c) / F.pow(x, F.lit(float(power)))
    for i in range(8):
        s = s - 1 / (m + F.lit(float(i)))
    return s


#: Rows that a key's tree is built on for each of its blocks, and blocks that a tree tells apart at most; more rows are dealt within them by hash.
SAMPLED, LEAVES = 32, 2048


def jittered(df: DataFrame, row: str, names: Sequence[str], scale: float = 1e-10) -> DataFrame:
    """df with an offset in [0, scale) on each of the columns, by row and column, so that equal values differ the same way in every run."""
    return df.withColumns({c: F.col(c) + F.lit(scale / 2**52) * F.shiftrightunsigned(F.xxhash64(row, F.lit(c)), 12) for c in names})


def _point(names: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in names])


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], *more: Column) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in keys] + list(more)


def blocks(df: DataFrame, keys: Sequence[str], row: str, names: Sequence[str]) -> DataFrame:
    """keys, row, x (the point) and block: the leaf of the key's tree, times a part of it if the leaf has more than ROWS rows.

    A key with up to ROWS rows is one block; if all keys are, nothing has to be cut, and one_block() tells. Trees split
    the widest side of a sample at its middle.
    """
    points = df.select(*keys, row, _point(names).alias("x"))
    most = points.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= ROWS:
        return points.withColumn("block", F.struct(F.lit(0).alias("_leaf"), F.lit(0).cast("long").alias("part")))
    size = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS)
    size = size.withColumn("_leaves", F.least(F.ceil(F.col("_n") / ROWS), F.lit(LEAVES)))
    on = list(keys)
    sized = points.join(size, on, "left") if on else points.join(F.broadcast(size), F.lit(True), "left")
    sampled = sized.where(F.pmod(F.xxhash64(row), F.greatest(F.lit(1), F.floor(F.col("_n") / (F.col("_leaves") * SAMPLED)))) == 0).where("_n IS NOT NULL")

    def build(g: pd.DataFrame) -> pd.DataFrame:
        x = np.array(g["x"].tolist(), float)
        depth = max(1, int(np.ceil(np.log2(max(g["_leaves"].iloc[0], 2)))))
        side, cut = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
        parts = [np.arange(len(x))]
        for node in range(2**depth - 1):
            own = x[parts[node]]
            if len(own):
                side[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                cut[node] = np.median(own[:, side[node]])
            right = own[:, side[node]] > cut[node] if len(own) else np.zeros(0, bool)
            parts += [parts[node][~right], parts[node][right]]
        return pd.DataFrame({**{c: g[c].iloc[:1].to_numpy() for c in keys}, "_side": [side.tolist()], "_cut": [cut.tolist()], "_depth": [depth]})

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keys)
    trees = sampled.groupBy(*keys).applyInPandas(build, f"{kinds}_side array<int>, _cut array<double>, _depth int")
    placed = sized.join(trees, on, "left") if on else sized.join(F.broadcast(trees), F.lit(True), "left")
    step = "aggregate(sequence(1, _depth), 0, (v, i) -> 2 * v + 1 + if(x[_side[v]] > _cut[v], 1, 0))"
    leaf = placed.select(*keys, row, "x", F.coalesce(F.expr(step), F.lit(0)).alias("_leaf"))
    full = leaf.groupBy(*keys, "_leaf").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("_parts"))
    whole = leaf.join(full, [*keys, "_leaf"])
    return materialize(whole.select(*keys, row, "x", F.struct("_leaf", F.pmod(F.xxhash64(row), F.col("_parts")).alias("part")).alias("block")), "blocks")


def one_block(cut: DataFrame) -> bool:
    """Whether each key of what blocks() returned is one block, so that no other has to be asked: the block is a constant then."""
    return not cut.schema["block"].nullable and not cut.schema["block"].dataType["part"].nullable


def boxes(cut: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """keys, block, n, lo, hi: the rows of each block and the corners of the smallest box that holds them."""
    ends = [[f(F.col("x")[i]) for i in range(dims)] for f in (F.min, F.max)]
    return cut.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"), *[F.array(*e).alias(name) for name, e in zip(("lo", "hi"), ends)])


_NEAREST = "greatest(0D, array_max(zip_with(zip_with(x, lo, (p, l) -> l - p), zip_with(x, hi, (p, h) -> p - h), (a, b) -> greatest(a, b))))"
_FARTHEST = "array_max(zip_with(zip_with(x, lo, (p, l) -> abs(p - l)), zip_with(x, hi, (p, h) -> abs(p - h)), (a, b) -> greatest(a, b)))"


def asked(cut: DataFrame, found: DataFrame, keys: Sequence[str], row: str, dims: int) -> DataFrame:
    """Rows with the other blocks that they ask: keys, row, x, reach, block, other, n and whole (the other's box lies within reach).

    found: keys, row and reach, a distance. Boxes meet boxes of their key first, by the largest reach of a block.
    """
    box = boxes(cut, keys, dims)
    near = cut.join(found, [*keys, row])
    most = near.groupBy(*keys, "block").agg(F.max("reach").alias("_most"))
    mine = box.join(most, [*keys, "block"]).select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("block").alias("_block"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_most")
    apart = " OR ".join(f"lo[{i}] - _hi[{i}] > _most OR _lo[{i}] - hi[{i}] > _most" for i in range(dims))
    met = box.join(mine, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] + [F.col("block") != F.col("_block"), ~F.expr(apart)])
    met = met.select(*keys, F.col("_block").alias("block"), F.col("block").alias("other"), "n", "lo", "hi")
    pairs = near.join(met, [*keys, "block"]).where(F.expr(_NEAREST) <= F.col("reach"))
    return pairs.select(*keys, row, "x", "reach", "block", "other", "n", (F.expr(_FARTHEST) <= F.col("reach")).alias("whole"))


def _units(asking: DataFrame, cut: DataFrame, keys: Sequence[str], row: str, carried: Sequence[str], run: Callable[[pd.DataFrame, pd.DataFrame], dict], found: str) -> DataFrame:
    """keys, row and what run gives for the asking rows of one block (row, x, carried) among the rows of another, for each pair of blocks that occurs."""
    if one_block(cut):
        held = cut.withColumn("other", F.col("block"))
    else:
        held = cut.withColumnRenamed("block", "other").join(asking.select(*keys, "block", "other").distinct(), [*keys, "other"])
    names = [*keys, "block", "other", row, "x"]
    none = [F.lit(None).cast(asking.schema[c].dataType).alias(c) for c in carried]
    both = asking.select(*names, *carried, F.lit(True).alias("_asks")).unionByName(held.select(*names, *none, F.lit(False).alias("_asks")))

    def unit(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["_asks"]], g[~g["_asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*keys, row, *(c.split()[0] for c in found.split(", "))])
        return pd.DataFrame({**{c: a[c].to_numpy() for c in (*keys, row)}, **run(a, b)})

    kinds = "".join(f"{c} {cut.schema[c].dataType.simpleString()}, " for c in (*keys, row))
    # Units weigh by their comparisons: a stated number of partitions keeps adaptive execution from merging them.
    parts = max(2 * cut.sparkSession.sparkContext.defaultParallelism, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(parts, *keys, "block", "other").groupBy(*keys, "block", "other").applyInPandas(unit, kinds + found)


def _points(f: pd.DataFrame) -> np.ndarray:
    return np.array(f["x"].tolist(), float).reshape(len(f), -1)


def _nearest(cut: DataFrame, keys: Sequence[str], row: str, dims: int, k: int, take: Callable[[pd.DataFrame, pd.DataFrame], list], kind: str) -> DataFrame:
    """keys, row and near: the k + 1 first of what take gives for a row (sorted, by distance first) over all blocks that may hold them."""
    run = lambda a, b: {"near": take(a, b)}
    own = _units(cut.withColumn("other", F.col("block")), cut, keys, row, [], run, f"near array<{kind}>")
    if one_block(cut):
        return own
    own = materialize(own, "nearest")
    first = (lambda c: c) if kind == "double" else (lambda c: c["d"])
    # A row that has too few neighbours in its block has to ask them all.
    reach = F.coalesce(first(F.get("near", F.lit(k))), F.lit(float("inf"))).alias("reach")
    far = materialize(asked(cut, own.select(*keys, row, reach), keys, row, dims), "asked")
    all_ = own.unionByName(_units(far, cut, keys, row, [], run, f"near array<{kind}>"))
    return all_.groupBy(*keys, row).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))


def kth_distances(df: DataFrame, keys: Sequence[str], row: str, spaces: Spaces, k: int = 3) -> DataFrame:
    """keys, row and for each space the Chebyshev distance to the k-th nearest other row of the key; null in a key of at most k rows."""
    take = lambda a, b: near.nearest(_points(a), _points(b), k + 1)[0].tolist()
    out = None
    for s, names in spaces.items():
        kth = _nearest(blocks(df, keys, row, names), keys, row, len(names), k, take, "double").select(*keys, row, F.get("near", F.lit(k)).alias(s))
        out = kth if out is None else _joined(out, kth, [*keys, row])
    return out


def _joined(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join whose null keys are equal."""
    b = b.withColumnsRenamed({c: f"_r_{c}" for c in on})
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]).drop(*[f"_r_{c}" for c in on])


def counts_within(df: DataFrame, keys: Sequence[str], row: str, eps: str, spaces: Spaces) -> DataFrame:
    """keys, row and for each space the number of rows of the key, itself included, closer than the row's eps."""
    run = lambda a, b: {"count": near.within(_points(a), _points(b), a["reach"].to_numpy(float))}
    reach = df.select(*keys, row, (F.col(eps) - F.lit(knn.ROUNDING)).alias("reach"))
    out = None
    for s, names in spaces.items():
        cut = blocks(df, keys, row, names)
        counts = _units(cut.join(reach, [*keys, row]).withColumn("other", F.col("block")), cut, keys, row, ["reach"], run, "count long")
        if not one_block(cut):
            far = materialize(asked(cut, reach, keys, row, len(names)), "asked")
            counts = counts.unionByName(_units(far.where("NOT whole"), cut, keys, row, ["reach"], run, "count long"))
            counts = counts.unionByName(far.where("whole").select(*keys, row, F.col("n").alias("count")))
        counts = counts.groupBy(*keys, row).agg(F.sum("count").alias(s))
        out = counts if out is None else _joined(out, counts, [*keys, row])
    return out


def _log(distance: str) -> Column:
    """The logarithm of a distance; minus infinity at 0."""
    return F.when(F.col(distance) == 0, F.lit(float("-inf"))).otherwise(F.log(distance))


def entropies(df: DataFrame, keys: Sequence[str], row: str, spaces: Spaces, k: int = 3) -> DataFrame:
    """keys, n and the entropy in bits of each space; null where a key has at most k rows. Rows with a null count as absent."""
    names = list(dict.fromkeys(c for s in spaces.values() for c in s))
    e = kth_distances(df.select(*keys, row, *names).dropna(subset=names), keys, row, spaces, k)
    n = F.count(F.lit(1))
    psi = digamma(n.cast("double")) - digamma(F.lit(float(k)))
    return e.groupBy(*keys).agg(n.alias("n"), *[((psi + len(c) * (F.lit(LN2) + F.avg(_log(s)))) / LN2).alias(s) for s, c in spaces.items()])


def information(df: DataFrame, keys: Sequence[str], row: str, x: Sequence[str], y: Sequence[str], z: Sequence[str] = (), k: int = 3, name: str = "mi") -> DataFrame:
    """keys and I(x; y), or I(x; y | z), in bits."""
    names = [*x, *y, *z]
    rows = df.select(*keys, row, *dict.fromkeys(names)).dropna(subset=names)
    # Each space's count reads the distances: they are searched once.
    eps = materialize(kth_distances(rows, keys, row, {"_eps": names}, k), "distances")
    spaces = {"_x": [*x, *z], "_y": [*y, *z]} | ({"_z": list(z)} if z else {})
    c = counts_within(rows.join(eps, [*keys, row]), keys, row, "_eps", spaces)
    mean = lambda s: F.avg(digamma(F.col(s).cast("double")))
    other = mean("_z") if z else digamma(F.count(F.lit(1)).cast("double"))
    return c.groupBy(*keys).agg(((digamma(F.lit(float(k))) + other - mean("_x") - mean("_y")) / LN2).alias(name))


def calibration(df: DataFrame, row: str, target: str, inputs: Sequence[str], k: int = 3, base: float = 2.0) -> dict:
    """Scale base ** (joint information - target entropy) of the z-scored columns of a wide table of any size, `row` telling its rows apart.

    Only complete rows count, for the z-scores too. Under 5 k of them, a constant column, and an undefined or non-positive
    information are errors. All that reaches the driver is a few numbers a column.
    """
    names = [target, *inputs]
    rows = materialize(df.select(row, *names).dropna().withColumn("_all", F.lit(0)), "calibration")
    n = rows.count()
    if n < 5 * k:
        raise ValueError(f"calibration takes at least {5 * k} complete rows, not {n}")
    scored = {}
    for c in names:
        q = ranks.quantiles(rows, ["_all"], c, {"med": 0.5, "q1": 0.25, "q3": 0.75}).first()
        off = F.col(c) - F.lit(q["med"])
        mad = ranks.quantiles(rows.withColumn("_off", F.abs(off)), ["_all"], "_off", {"mad": 0.5}).first()["mad"]
        if mad > normalize.NEARLY_ZERO:
            scored[c] = off * F.lit(normalize.MAD_FACTOR / mad)
        elif q["q3"] > q["q1"]:
            scored[c] = off * F.lit(normalize.IQR_FACTOR / (q["q3"] - q["q1"]))
        else:
            raise ValueError(f"series {c} is constant")
    z = rows.withColumns(scored)
    unit = LN2 / math.log(base)
    h = entropies(z, ["_all"], row, {"h": [target]}, k).first()["h"] * unit
    info = information(z, ["_all"], row, list(inputs), [target], k=k).first()["mi"] * unit
    if not info > 0:
        raise ValueError("the inputs tell nothing about the target")
    return {"target": target, "inputs": list(inputs), "jmi_bits": info, "entropy_bits": h, "scale": base ** (info - h), "k": k}


def corrections(df: DataFrame, keys: Sequence[str], row: str, names: Sequence[str], alpha: float, k: int = 3) -> DataFrame:
    """keys and lnc: the mean correction, in bits, for local non-uniformity of the joint space `names`."""

    def take(a: pd.DataFrame, b: pd.DataFrame) -> list:
        p, q, own = _points(a), _points(b), a[row].to_numpy()
        # A few more than are kept, so that of equally distant ones the same come first wherever they lie.
        d, at = near.nearest(p, q, k + 5)
        itself = b[row].to_numpy()[at] == own[:, None]
        d[itself] = np.inf
        order = np.lexsort((*[q[at, c] for c in range(q.shape[1] - 1, -1, -1)], d), axis=1)[:, : k + 1]
        d, at = np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)
        mine = np.isin(own, b[row].to_numpy())
        others = [[(v, w) for v, w in zip(*r) if v < np.inf] for r in zip(d.tolist(), q[at].tolist())]
        return [([(-1.0, s)] if m else []) + o[: k + 1 - m] for m, s, o in zip(mine.tolist(), p.tolist(), others)]

    cut = blocks(df.dropna(subset=list(names)), keys, row, names)
    nearest = _nearest(cut, keys, row, len(names), k, take, "struct<d: double, x: array<double>>").withColumn("near", F.transform("near", lambda p: p["x"]))

    @F.pandas_udf(DoubleType())
    def gain(near: pd.Series) -> pd.Series:
        return pd.Series(knn.local_correction(np.array([[list(p) for p in v] for v in near], float), alpha) if len(near) else [], dtype=float)

    return nearest.groupBy(*keys).agg((F.avg(gain("near")) / LN2).alias("lnc"))


def divergence(df: DataFrame, keys: Sequence[str], row: str, names: Sequence[str], side: str, k: int = 3) -> DataFrame:
    """keys and kl: the divergence in bits of the rows with side 0 from those with side 1.

    Not a number where both have rows with k equal neighbours, else infinite where one has.
    """
    rows = df.select(*keys, row, *names, side).dropna(subset=[*names, side])
    cut = _joined(blocks(rows, keys, row, names), rows.select(*keys, row, side), [*keys, row])
    zero, one = cut.where(F.col(side) == 0).drop(side), cut.where(F.col(side) == 1).drop(side)

    def to(held: DataFrame, least: int) -> DataFrame:
        """keys, row and reach of rows of side 0: the distance to the (least + 1)-th of held."""
        take = lambda a, b: {"near": near.nearest(_points(a), _points(b), least + 1)[0].tolist()}
        # Rows ask their own block's box first; if it holds too few of the other side, all of them.
        own = _units(_present(zero.withColumn("other", F.col("block")), held, keys), held, keys, row, [], take, "near array<double>")
        if one_block(cut):
            return own.select(*keys, row, F.get("near", F.lit(least)).alias("d"))
        own = materialize(own, "nearest")
        known = zero.select(*keys, row).join(own, [*keys, row], "left")
        reach = F.coalesce(F.get("near", F.lit(least)), F.lit(float("inf"))).alias("reach")
        far = materialize(_present(asked(cut, known.select(*keys, row, reach), keys, row, len(names)), held, keys), "asked")
        all_ = own.unionByName(_units(far, held, keys, row, [], take, "near array<double>"))
        return all_.groupBy(*keys, row).agg(F.get(F.array_sort(F.flatten(F.collect_list("near"))), F.lit(least)).alias("d"))

    both = to(zero, k).withColumnRenamed("d", "own").join(to(one, k - 1).withColumnRenamed("d", "cross"), [*keys, row])
    n = rows.groupBy(*keys).agg(F.count_if(F.col(side) == 0).alias("n"), F.count_if(F.col(side) == 1).alias("m"))
    mean = both.groupBy(*keys).agg((F.avg(_log("cross")) - F.avg(_log("own"))).alias("gap"))
    return mean.join(n, list(keys)).select(*keys, ((F.log("m") - F.log(F.col("n") - 1) + len(names) * F.col("gap")) / LN2).alias("kl"))


def _present(asking: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Asking rows whose other block has rows in held."""
    return asking.join(held.select(*keys, F.col("block").alias("other")).distinct(), [*keys, "other"], "left_semi")


def given_groups(df: DataFrame, keys: Sequence[str], row: str, spaces: Spaces, group: str, k: int = 3, whole: DataFrame | None = None) -> DataFrame:
    """keys and, for each space, its entropy given the discrete `group`: group entropies by share; a group of at most k rows counts with that of all.

    whole: the entropies of all rows of a key, where they are known.
    """
    names = list(dict.fromkeys(c for s in spaces.values() for c in s))
    rows = df.dropna(subset=[*names, group])
    whole = whole or entropies(rows, keys, row, spaces, k)
    whole = whole.select(*keys, F.col("n").alias("_n"), *[F.col(s).alias(f"_{s}") for s in spaces])
    parts = entropies(rows, [*keys, group], row, spaces, k).join(whole, list(keys))
    share = F.col("n") / F.col("_n")
    return parts.groupBy(*keys).agg(*[F.sum(share * F.coalesce(s, f"_{s}")).alias(s) for s in spaces])


def mixed_information(df: DataFrame, keys: Sequence[str], row: str, x: Sequence[str], groups: Sequence[str], k: int = 3, name: str = "mi", whole: DataFrame | None = None) -> DataFrame:
    """keys and the information in bits between continuous x and the discrete columns `groups` together; rows with a null don't count.

    whole: keys, n and x, the entropy of x, where it is known.
    """
    rows = df.select(*keys, row, *x, *groups).dropna(subset=[*x, *groups]).withColumn("_group", F.to_json(F.struct(*groups)))
    whole = whole or materialize(entropies(rows, keys, row, {"x": x}, k), "whole")
    given = given_groups(rows, keys, row, {"x": x}, "_group", k, whole).withColumnRenamed("x", "_given")
    return whole.join(given, list(keys)).select(*keys, F.abs(F.col("x") - F.col("_given")).alias(name))


#: The published entropy of x given groups hands its base, 2, to the estimator as the neighbour count.
PUBLISHED_K = 2


def mixed_correlations(df: DataFrame, keys: Sequence[str], row: str, x: Sequence[str], groups: Sequence[str], k: int = 3) -> DataFrame:
    """keys and, in bits, h_given (of continuous x given the discrete columns `groups` together), ctc and corex.

    ctc is the sum of h_given over single columns less that of all, corex the columns' total correlation less ctc, as published:
    h_given is an entropy with PUBLISHED_K neighbours less an information with k. Rows with a null don't count.
    """
    rows = materialize(df.select(*keys, row, *x, *groups).dropna(subset=[*x, *groups]), "mixed")
    whole = materialize(entropies(rows, keys, row, {"x": x}, k), "whole")
    table = entropies(rows, keys, row, {"_h": x}, PUBLISHED_K).select(*keys, "_h").join(mixed_information(rows, keys, row, x, groups, k, "_m", whole), list(keys))
    for i, g in enumerate(groups):
        table = table.join(mixed_information(rows, keys, row, x, [g], k, f"_m{i}", whole), list(keys)).join(discrete.entropy_by(rows, keys, [g], f"_d{i}"), list(keys))
    table = table.join(discrete.entropy_by(rows, keys, groups, "_d"), list(keys))
    total = lambda f: reduce(lambda p, q: p + q, [f(i) for i in range(len(groups))])
    table = table.withColumn("h_given", F.col("_h") - F.col("_m")).withColumn("ctc", total(lambda i: F.col("_h") - F.col(f"_m{i}")) - F.col("h_given"))
    return table.select(*keys, "h_given", "ctc", (total(lambda i: F.col(f"_d{i}")) - F.col("_d") - F.col("ctc")).alias("corex"))


Measure = Callable[[DataFrame, Sequence[str]], DataFrame]


def shuffle_test(
    df: DataFrame, keys: Sequence[str], row: str, x: Sequence[str], y: Sequence[str], z: Sequence[str] = (), ns: int = 200, ci: float = 0.95, k: int = 3, measure: Measure | None = None, alone: Callable | None = None
) -> DataFrame:
    """keys, mean, low, high over ns replicates of a measure of permuted x, y and z.

    measure: of rows (keys, row, x, y, z) and keys, gives keys and mi; by default the information between x and y, given z.
    alone: the same measure of arrays (x, y, z). Keys of up to HELD rows go to the tasks once for DRAWN replicates, which are
    drawn and measured there; other keys' rows are dealt by blocks, replicate by replicate, as all are if a measure has no `alone`.
    A replicate permutes x within its key by the order of a digest, so results don't depend on how rows are dealt.
    """
    names = [*x, *y, *z]
    rows = df.select(*keys, row, *names).dropna(subset=[*keys, *names])
    if measure is None:
        alone = lambda a, b, c: near.information(a, b, c, k)
    if alone is None:
        v = _spread_replicates(rows, keys, row, x, y, z, ns, k, measure)
    else:
        size = rows.groupBy(*keys).agg((F.count(F.lit(1)) > HELD).alias("_large"))
        if not size.where("_large").isEmpty():
            on = lambda large: rows.join(size.where(F.col("_large") == large).drop("_large"), list(keys), "left_semi") if keys else rows.limit(0) if not large else rows
            v = _held_replicates(on(False), keys, row, x, y, z, ns, alone).unionByName(_spread_replicates(on(True), keys, row, x, y, z, ns, k, measure).select(*keys, "mi"))
        else:
            v = _held_replicates(rows, keys, row, x, y, z, ns, alone)
    sorted_ = F.array_sort(F.collect_list("mi"))
    return v.groupBy(*keys).agg(F.avg("mi").alias("mean"), F.get(sorted_, F.lit(int((1 - ci) / 2 * ns))).alias("low"), F.get(sorted_, F.lit(int((1 + ci) / 2 * ns))).alias("high"))


#: Rows of a key up to which a task draws its replicates, and replicates of a task's group.
HELD, DRAWN = 200_000, 10


def _held_replicates(rows: DataFrame, keys: Sequence[str], row: str, x: Sequence[str], y: Sequence[str], z: Sequence[str], ns: int, alone: Callable) -> DataFrame:
    """keys and mi of each replicate, a group for each key and DRAWN replicates."""

    def numbers(g: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
        # A column that isn't of numbers only tells groups apart.
        parts = [g[c].to_numpy(float) if pd.api.types.is_numeric_dtype(g[c]) else pd.factorize(g[c])[0].astype(float) for c in names]
        return np.column_stack(parts) if parts else np.zeros((len(g), 0))

    def run(group: pa.Table) -> pa.Table:
        g = group.to_pandas().sort_values(row, kind="stable", na_position="first")
        own, other, given = numbers(g, x), numbers(g, y), numbers(g, z)
        first, heads = int(g["_chunk"].iloc[0]) * DRAWN, [h.encode() for h in g["_head"]]
        found = []
        for rep in range(first, min(first + DRAWN, ns)):
            tail = str(rep).encode()
            digests = np.frombuffer(b"".join([hashlib.md5(h + tail).digest() for h in heads]), ">u8").reshape(-1, 2)
            found.append(alone(own[np.lexsort((digests[:, 1], digests[:, 0]))], other, given))
        return pa.table({**{c: pa.chunked_array([group[c].combine_chunks().take(pa.array([0] * len(found)))]) for c in keys}, "mi": pa.array(found, pa.float64())})

    chunks = F.explode(F.sequence(F.lit(0), F.lit(-(-ns // DRAWN) - 1)))
    dealt = rows.withColumn("_head", F.coalesce(F.concat(F.col(row).cast("string"), F.lit(":")), F.lit(""))).withColumn("_chunk", chunks)
    parts = max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keys)
    return dealt.repartition(parts, *keys, "_chunk").groupBy(*keys, "_chunk").applyInArrow(run, f"{kinds}mi double")


def _spread_replicates(rows: DataFrame, keys: Sequence[str], row: str, x: Sequence[str], y: Sequence[str], z: Sequence[str], ns: int, k: int, measure: Measure | None) -> DataFrame:
    """keys, _rep and mi of each replicate, for keys of any size: every replicate's rows are a key of their own."""
    rows = rows.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(ns - 1))))
    own = [*keys, "_rep"]
    place = lambda *by: F.row_number().over(Window.partitionBy(*own).orderBy(*by)).alias("_at")
    drawn = rows.select(*own, *x, place(F.md5(F.concat_ws(":", F.col(row).cast("string"), F.col("_rep").cast("string"))), F.col(row)))
    fixed = rows.select(*own, row, *y, *z, place(F.col(row)))
    paired = materialize(fixed.join(drawn, [*own, "_at"]).drop("_at"), "shuffled")
    return measure(paired, own) if measure else information(paired, own, row, x, y, z, k)


@F.pandas_udf(DoubleType())
def ksg_entropy(values: pd.Series) -> pd.Series:
    """Entropy in bits of an array column."""
    return values.map(lambda v: knn.window_entropy(np.asarray(v, float)))


def te_bits(x: Column, y: Column, tau: int = 1, history: int = 1) -> Column:
    """Transfer entropy in bits between two array columns of equal length."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([max(knn.transfer_entropy([np.asarray(p, float)], np.asarray(q, float), [tau], history)[0], 0.0) for p, q in zip(a, b)])

    return run(x, y)


@F.pandas_udf(DoubleType())
def _te_of_arrays(x: pd.Series, y: pd.Series, tau: pd.Series, history: pd.Series) -> pd.Series:
    return pd.Series([max(knn.transfer_entropy([np.asarray(p, float)], np.asarray(q, float), [int(t)], int(h))[0], 0.0) for p, q, t, h in zip(x, y, tau, history)], dtype=float)


def register(spark: SparkSession) -> None:
    """Name the estimators for SQL text: te_bits(x, y, tau, history) of two arrays of equal length, ksg_entropy(values); null elements are missing."""
    spark.udf.register("te_bits", _te_of_arrays)
    spark.udf.register("ksg_entropy", ksg_entropy)
