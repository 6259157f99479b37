"""Operators on ordered series that no single task has to hold: two-level scans over blocks of positions.

A block is SPAN consecutive values of a whole-number order column, so rows find theirs by arithmetic. Level one works
within the blocks of a key. What the blocks leave open, their edges and totals, is one short row a block; level two scans
these rows and hands each block what lies before and after it. The first level is written to the shared folder, as both
the second and the join back read it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.scratch import materialize

SPAN = 50_000


def same(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """a joined to b on equal columns, nulls equal as well."""
    b = b.withColumnsRenamed({c: f"_r_{c}" for c in on})
    joined = a.join(b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on], how) if on else a.join(F.broadcast(b), F.lit(True), how)
    return joined.drop(*[f"_r_{c}" for c in on])


def _blocked(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(order) / SPAN))


def _within(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys, "_b").orderBy(order)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, flag: Column, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with _b, its block, and run, a number from 1 that is the same along consecutive rows of equal flag."""
    d = _blocked(df, order).withColumn("_f", flag)
    w = _within(keys, order)
    d = d.withColumn("_c", F.when((F.row_number().over(w) == 1) | F.lag("_f").over(w).eqNullSafe(F.col("_f")), 0).otherwise(1)).withColumn("_c", F.sum("_c").over(w))
    d = materialize(d, "runs")
    edges = d.groupBy(*keys, "_b").agg(F.min_by("_f", order).alias("_first"), F.max_by("_f", order).alias("_last"), F.max("_c").alias("_changes"))
    line = Window.partitionBy(*keys).orderBy("_b")
    edges = edges.withColumn("_opens", F.when((F.row_number().over(line) > 1) & F.lag("_last").over(line).eqNullSafe(F.col("_first")), 0).otherwise(1))
    start = F.sum("_opens").over(line) + F.coalesce(F.sum("_changes").over(_before(keys)), F.lit(0))
    edges = edges.select(*keys, "_b", start.alias("_start"))
    return same(d, edges, [*keys, "_b"]).withColumn("run", F.col("_start") + F.col("_c")).drop("_f", "_c", "_start")


def _parts(d: DataFrame, keys: Sequence[str], order: str, valid: str | None) -> DataFrame:
    """A row for each run and block that share rows."""
    ok = F.lit(True) if valid is None else F.min(valid)
    return d.groupBy(*keys, "_b", "run").agg(F.count(F.lit(1)).alias("_rows"), F.min(order).alias("_lo"), F.max(order).alias("_hi"), ok.alias("_whole"))


def _facts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    whole = parts.groupBy(*keys, "run").agg(F.sum("_rows").alias("_rows"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min("_whole").alias("_whole"))
    ends = whole.groupBy(*keys).agg(F.min("run").alias("_first_run"), F.max("run").alias("_last_run"))
    return same(whole, ends, keys)


def run_facts(d: DataFrame, keys: Sequence[str], order: str, valid: str | None = None) -> DataFrame:
    """Of what numbered() returns, a row a run: rows, first and last place, whether all rows are valid, and the key's first and last run."""
    return _facts(_parts(d, keys, order, valid), keys)


def with_run_facts(d: DataFrame, keys: Sequence[str], order: str, valid: str | None = None) -> DataFrame:
    """Rows of numbered() with the facts of their run; they meet by block, so a long run's rows stay apart."""
    parts = _parts(d, keys, order, valid)
    by_block = same(parts.select(*keys, "_b", "run"), _facts(parts, keys).drop("_lo", "_hi"), [*keys, "run"])
    return same(d, by_block, [*keys, "_b", "run"])


def neighbours(df: DataFrame, keys: Sequence[str], order: str, there: Column, *columns: str) -> DataFrame:
    """df with _back and _ahead: order and columns of the nearest rows, itself included, on either side of which `there` holds."""
    d = _blocked(df, order).withColumn("_s", F.when(there, F.struct(order, *columns)))
    w = _within(keys, order)
    d = d.withColumns({"_back": F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_ahead": F.first("_s", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    d = materialize(d, "neighbours")
    ends = d.groupBy(*keys, "_b").agg(F.min("_s").alias("_min"), F.max("_s").alias("_max"))
    after = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(*keys, "_b", F.last("_max", True).over(_before(keys)).alias("_left"), F.first("_min", True).over(after).alias("_right"))
    found = same(d, ends, [*keys, "_b"]).withColumns({"_back": F.coalesce("_back", "_left"), "_ahead": F.coalesce("_ahead", "_right")})
    return found.drop("_b", "_s", "_left", "_right")


def positions(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """df with _pos, the place of each row in its key from 0 on."""
    d = materialize(_blocked(df, order).withColumn("_pos", F.row_number().over(_within(keys, order)) - 1), "positions")
    ahead = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
    return same(d, ahead, [*keys, "_b"]).withColumn("_pos", (F.col("_pos") + F.col("_n")).cast("long")).drop("_b", "_n")


#: Rows whose medians one call works out, beside the rows around them.
MEDIANS = 5000


def sliding_medians(values: np.ndarray, at: range, before: int, after: int, least: int) -> list[float | None]:
    """For each place in `at`, the median of the values from `before` places ahead of it to `after` behind, nan left out.

    The window is a sorted list: a step looks up what leaves and what enters by bisection, and reads the middle by its index.
    """
    held: list[float] = []
    lo = hi = max(0, at.start - before)
    out: list[float | None] = []
    for c in at:
        while hi < min(len(values), c + after + 1):
            if values[hi] == values[hi]:
                insort(held, values[hi])
            hi += 1
        while lo < c - before:
            if values[lo] == values[lo]:
                del held[bisect_left(held, values[lo])]
            lo += 1
        n = len(held)
        out.append(None if n < max(least, 1) else (held[n // 2] if n % 2 else held[n // 2 - 1] + (held[n // 2] - held[n // 2 - 1]) / 2))
    return out


def rolling_median(df: DataFrame, keys: Sequence[str], n: int, value: str, order: str, least: int) -> DataFrame:
    """df with baseline: the median of n rows around each, from n // 2 before on; null with under `least` values.

    Rows are dealt by place to blocks, with as many rows around a block as its first and last window need.
    """
    before, after = n // 2, n - 1 - n // 2
    size = max(MEDIANS, n)
    d = positions(df, keys, order)
    blocks = F.sequence(F.floor((F.col("_pos") - after) / size), F.floor((F.col("_pos") + before) / size))
    dealt = d.withColumn("_m", F.explode(F.filter(blocks, lambda b: b >= 0)))
    names, schema = df.columns, StructType([*df.schema.fields, StructField("baseline", DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_pos")
        pos, block = t.column("_pos").to_numpy(), t.column("_m")[0].as_py()
        lo, hi = np.searchsorted(pos, [block * size, (block + 1) * size])
        values = t.column(value).cast(pa.float64()).to_numpy().astype(float)
        found = sliding_medians(values.tolist(), range(int(lo), int(hi)), before, after, least)
        own = t.select(names).slice(int(lo), int(hi - lo))
        return own.append_column("baseline", pa.array(found, pa.float64()))

    # Few bytes, much work: a stated number of partitions, which adaptive execution leaves alone.
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, *keys, "_m").groupBy(*keys, "_m").applyInArrow(run, schema)
