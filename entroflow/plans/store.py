"""Transfer entropy kept between runs: a Parquet store of window results, of which only missing ones are computed.

A result is known by its specification (target, lagged sources, history, k, window length), the place of its window, and a
fingerprint of the values in it. Changed rows change the fingerprints of the windows that hold them, and of no others.
New results are appended; old ones stay, so going back to earlier data computes nothing either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from . import rolling
from .catalog import Entity

SCHEMA = "spec string, centre long, fingerprint long, te_raw double, status string"
#: Window centres whose fingerprints one task works out, beside the rows around them.
CENTRES = 4096


def spec_of(e: Entity, window_points: int, k: int, columns: Mapping[str, Sequence[str]]) -> str:
    return f"{e.target}<{'+'.join(f'{','.join(columns[b])}__t{t}' for b, t in e.sources)} h{e.history} k{k} w{window_points}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store; empty where there is none yet. A result that two runs appended counts once."""
    try:
        found = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    return found.dropDuplicates(["spec", "centre", "fingerprint"])


def fingerprints(grid: DataFrame, entities: Sequence[Entity], window_points: int, k: int = 3, vector_bases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """entity_no, spec, centre, us, window_idx, fingerprint of every full window of every entity."""
    own, columns, _ = rolling._setup(entities, vector_bases)
    half = window_points // 2
    rows = grid.select("idx", "us", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*(c for v in columns.values() for c in v), *(e.target for e in own)])])
    ends = grid.agg(F.min("idx").alias("_first"), F.max("idx").alias("_last"))  # one row

    def mark(e: Entity):
        names = [c for b, _ in e.sources for c in columns[b]] + [e.target]
        return F.xxhash64("idx", *[x for c in names for x in (F.col(c).isNull(), c)])

    block = F.explode(F.sequence(F.floor((F.col("idx") - half + 1) / CENTRES), F.floor((F.col("idx") + half) / CENTRES)))
    frame = Window.partitionBy("_block").orderBy("idx").rangeBetween(-half, half - 1)
    d = rows.select("idx", "us", block.alias("_block"), *[mark(e).alias(f"_m{i}") for i, e in enumerate(own)])
    d = d.select("idx", "us", "_block", F.count(F.lit(1)).over(frame).alias("_rows"), *[F.bit_xor(f"_m{i}").over(frame).alias(f"_m{i}") for i in range(len(own))])
    d = d.join(F.broadcast(ends)).where((F.floor(F.col("idx") / CENTRES) == F.col("_block")) & (F.col("_rows") == 2 * half) & F.col("idx").between(F.col("_first") + half, F.col("_last") - half))
    each = F.array(*[F.struct(F.lit(i).alias("entity_no"), F.lit(spec_of(e, window_points, k, columns)).alias("spec"), F.col(f"_m{i}").alias("fingerprint")) for i, e in enumerate(own)])
    return d.select(F.explode(each).alias("e"), F.col("idx").alias("centre"), "us", (F.col("idx") - F.col("_first") - half).alias("window_idx")).select("e.*", "centre", "us", "window_idx")


def rolling_te(grid: DataFrame, entities: Sequence[Entity], window_points: int, path: str, k: int = 3, vector_bases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """rolling.rolling_te's rows, of which those that the store at `path` lacks are computed and appended to it."""
    spark = grid.sparkSession
    own, _, _ = rolling._setup(entities, vector_bases)
    wanted = materialize(fingerprints(grid, entities, window_points, k, vector_bases), "fingerprints")
    key = ["spec", "centre", "fingerprint"]
    missing = wanted.join(read(spark, path), key, "left_anti")
    if not missing.isEmpty():
        todo = missing.select("entity_no", "centre")
        made = rolling.rolling_te(grid, own, window_points, k, vector_bases=vector_bases, only=todo)
        names = spark.createDataFrame([(i, e.target, e.name, e.history) for i, e in enumerate(own)], "entity_no int, target string, entity string, history int")
        made = made.join(F.broadcast(names), ["target", "entity", "history"]).select("entity_no", "window_idx", "te_raw", "status")
        missing.join(made, ["entity_no", "window_idx"]).select("spec", "centre", "fingerprint", "te_raw", "status").write.mode("append").parquet(path)
    what = spark.createDataFrame([(i, e.target, e.name, e.history) for i, e in enumerate(own)], "entity_no int, target string, entity string, history int")
    found = wanted.join(read(spark, path), key).join(F.broadcast(what), "entity_no")
    return found.select("target", "entity", "history", "window_idx", "us", "te_raw", F.greatest("te_raw", F.lit(0.0)).alias("te_bits"), "status")
