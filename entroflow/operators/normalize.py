"""Robust normalisation and circular encoding of long series tables (keys, us, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import knn
from . import ranks
from .scan import same

MAD_FACTOR, IQR_FACTOR, NEARLY_ZERO = 0.6745, 1.349, 1e-8


def robust_scale(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """By key: _n, _median, _mad, _iqr of the non-null values, by exact quantiles of keys of any size."""
    rows, keys = df.select(*keys, F.col(value).alias("_v")), list(keys)
    held = ranks.small(rows, keys)
    middle = ranks.quantiles(rows, keys, "_v", {"_median": 0.5, "_q1": 0.25, "_q3": 0.75}, held)
    off = same(rows, middle, keys).select(*keys, F.abs(F.col("_v") - F.col("_median")).alias("_off"))
    scale = same(middle, ranks.quantiles(off, keys, "_off", {"_mad": 0.5}, held), keys)
    n = rows.groupBy(*keys).agg(F.count("_v").alias("_n"))
    return same(n, scale, keys).select(*keys, "_n", "_median", "_mad", (F.col("_q3") - F.col("_q1")).alias("_iqr"))


def zscore_of(value: Column, scale: float = 1.0) -> Column:
    """The robust z-score from the columns of robust_scale: by the MAD, by the IQR if that is zero, all zeros if both are.

    Under two values leave the series as it is.
    """
    off = value - F.col("_median")
    by_mad = F.lit(scale * MAD_FACTOR) * off / F.col("_mad")
    by_iqr = F.lit(scale) * off / (F.col("_iqr") / F.lit(IQR_FACTOR))
    return F.when(F.col("_n") < 2, value).when(F.col("_mad") > NEARLY_ZERO, by_mad).when(F.col("_iqr") != 0, by_iqr).otherwise(F.lit(0.0))


def robust_zscore(df: DataFrame, value: str = "value", keys: Sequence[str] = (), scale: float = 1.0, strict: bool = False) -> DataFrame:
    """df with z. strict: a constant series is an error."""
    s = robust_scale(df, value, keys)
    if strict and not s.where((F.col("_mad") <= NEARLY_ZERO) & (F.col("_iqr") == 0)).isEmpty():
        raise ValueError("a series is constant")
    return same(df, s, keys).withColumn("z", zscore_of(F.col(value), scale)).drop("_n", "_median", "_mad", "_iqr")


def circular_components(df: DataFrame, degrees: str = "value", keys: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """df with sin and cos of degrees, less their medians, over the median absolute deviation of both together."""
    parts = df.withColumns({"_s": F.sin(F.radians(degrees)), "_c": F.cos(F.radians(degrees))})
    held = ranks.small(parts, keys)
    for c, name in (("_s", "_ms"), ("_c", "_mc")):
        parts = same(parts, ranks.quantiles(parts.select(*keys, c), keys, c, {name: 0.5}, held), keys)
    off = parts.withColumns({"_s": F.col("_s") - F.col("_ms"), "_c": F.col("_c") - F.col("_mc")})
    both = off.select(*keys, F.explode(F.array(F.abs("_s"), F.abs("_c"))).alias("_x"))
    joined = same(off, ranks.quantiles(both, keys, "_x", {"_mad": 0.5}, held), keys)
    factor = F.lit(scale * MAD_FACTOR) / F.col("_mad")
    return joined.withColumns({"sin": F.col("_s") * factor, "cos": F.col("_c") * factor}).drop("_s", "_c", "_ms", "_mc", "_mad")


def beta_calibration(df: DataFrame, target: str, inputs: Sequence[str], k: int = 3, base: float = 2.0, most: int = 5000) -> dict:
    """Scale base ** (joint information - target entropy) of z-scored columns of a wide calibration table.

    The calibration period is a bounded table: over `most` complete rows are an error, as are under 5 k of them, a
    constant column, and an undefined or non-positive information.
    """
    names = [target, *inputs]
    data = df.select(*names).dropna().limit(most + 1).toPandas()
    if len(data) > most or len(data) < 5 * k:
        raise ValueError(f"calibration takes {5 * k} to {most} complete rows")
    off = data - data.median()
    mad, iqr = off.abs().median(), data.quantile(0.75) - data.quantile(0.25)
    if ((mad <= NEARLY_ZERO) & (iqr == 0)).any():
        raise ValueError("a series is constant")
    data = off * (MAD_FACTOR / mad).where(mad > NEARLY_ZERO, IQR_FACTOR / iqr)
    h = knn.entropy(data[target].to_numpy(), k, base)
    info = max(0.0, knn.mutual_information(data[list(inputs)].to_numpy(), data[target].to_numpy(), k=k, base=base))
    if not info > 0:
        raise ValueError("the inputs tell nothing about the target")
    return {"target": target, "inputs": list(inputs), "jmi_bits": info, "entropy_bits": h, "scale": float(base ** (info - h)), "k": k}


def circularity(df: DataFrame, degrees: str, keys: Sequence[str] = (), north: float = 45.0) -> DataFrame:
    """Checks of an angle's encoding by key: rows, missing ones, the worst of |sin2 + cos2 - 1|, and directions within `north` of 0 with their spread."""
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    northerly = c > F.cos(F.radians(F.lit(north)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(degrees).isNull()).alias("n_missing"), F.max(F.abs(s * s + c * c - 1)).alias("worst"),
        F.count_if(northerly).alias("n_northerly"), F.stddev_pop(F.when(northerly, s)).alias("northerly_spread"),
    )
