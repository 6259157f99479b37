"""Streaming counterparts: tumbling aggregates with late data, and a robust running score per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_sums(stream: DataFrame, ts: str, value: str, keys: list[str], width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sum, mean and count of value by key and tumbling window; rows later than the watermark are left out."""
    w = F.window("_ts", width)
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).groupBy(*keys, w).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "total", "mean", "n")


def running_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and population standard deviation by key so far, updated with each batch."""

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, spread = state.get if state.exists else (0, 0.0, 0.0)
        for b in batches:
            v = b[value].dropna().to_numpy(float)
            if len(v):
                # Two sets of values merge by their counts, means and sums of squared deviations.
                step, both = v.mean() - mean, n + len(v)
                spread += ((v - v.mean()) ** 2).sum() + step**2 * n * len(v) / both
                mean += step * len(v) / both
                n = both
        state.update((n, float(mean), float(spread)))
        yield pd.DataFrame({key: [name[0]], "n": [n], "mean": [mean], "std": [(spread / n) ** 0.5 if n else 0.0]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, mean double, std double", "n long, mean double, spread double", "update", GroupStateTimeout.NoTimeout)
