"""Window results packed for keeping and exchange: a row holds many windows as arrays beside what is said about them all.

    {"part", "timestamps": ["2024-01-31 18:00:00", ..], "windows": [..], <value>: [..], .., "about": {..}}

A packed row is a VARIANT, so its fields are read by path without a schema, and `F.to_json` makes text of it. A key's windows are
cut by their place into parts of bounded length, so no row grows with the data. Times have whole seconds; values that are NaN
are kept as null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows of one packed row.
PART = 50_000
TIME = "yyyy-MM-dd HH:mm:ss"


def pack(df: DataFrame, keys: Sequence[str], values: Sequence[str], about: DataFrame | None = None, order: str = "window_idx", part: int = PART) -> DataFrame:
    """keys and packed (VARIANT) of rows with keys, order, us and values, one row a key and part.

    `about` has at most one row a key; its other columns are the packed rows' "about". Null keys are keys like others; rows
    without a place are left out, those that share a place are all kept, by time and values.
    """
    rows = df.where(F.col(order).isNotNull()).select(
        *keys, F.floor(F.col(order) / part).alias("_part"), F.struct(F.col(order).cast("long").alias("w"), F.date_format(F.timestamp_micros("us"), TIME).alias("t"), *[F.nanvl(F.col(v).cast("double"), F.lit(None)).alias(f"v{i}") for i, v in enumerate(values)]).alias("_w")
    )
    d = rows.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list("_w")).alias("_w"))
    fields = [F.col("_part").alias("part"), F.col("_w.t").alias("timestamps"), F.col("_w.w").alias("windows"), *[F.col("_w")[f"v{i}"].alias(v) for i, v in enumerate(values)]]
    if about is not None:
        said = about.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*[c for c in about.columns if c not in keys]).alias("about"))
        d = d.join(said, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left") if keys else d.join(said, how="left")
        fields.append(F.col("about"))
    return d.select(*keys, F.to_variant_object(F.struct(*fields)).alias("packed"))


def from_json(df: DataFrame, column: str = "packed") -> DataFrame:
    """df with text that was made by to_json as VARIANT again; text that isn't JSON becomes null."""
    return df.withColumn(column, F.try_parse_json(column))


def said(packed: Column, path: str, kind: str) -> Column:
    """A field of what is said about all windows, such as "target" or "synergy_stats.mean_jte"; null where it is absent or of another kind."""
    return F.try_variant_get(packed, f"$.about.{path}", kind)


def unpack(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str = "window_idx", column: str = "packed") -> DataFrame:
    """The rows that pack was given: keys, order, us, values. A value that a packed row doesn't hold is null."""
    get = lambda name, kind: F.try_variant_get(column, f"$.{name}", f"array<{kind}>")
    fields = [get("windows", "bigint").alias("_w"), get("timestamps", "string").alias("_t"), *[get(v, "double").alias(f"_v{i}") for i, v in enumerate(values)]]
    d = df.select(*keys, *fields)
    names = ["_w", "_t", *(f"_v{i}" for i in range(len(values)))]
    d = d.select(*keys, F.explode(F.arrays_zip(*[F.coalesce(n, F.array()) for n in names])).alias("_r"))
    return d.select(*keys, F.col("_r")["0"].alias(order), F.unix_micros(F.to_timestamp(F.col("_r")["1"], TIME)).alias("us"), *[F.col("_r")[str(i + 2)].alias(v) for i, v in enumerate(values)])
