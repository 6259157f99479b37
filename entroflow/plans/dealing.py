"""Dealing of compute-heavy groups: few rows, much work, so bytes say nothing about a partition's time.

A unit is a bounded group of rows that one call handles. Units lie on a line by the work before them, in equal stretches
that are the partitions; each series begins at a place of its own, and the line wraps around. So a long series
gives every partition the same work, and many short ones spread by chance. The number of partitions is stated, which
adaptive execution leaves alone; it doesn't merge them for being small in bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Evaluations that a partition gets, some ten seconds, where there are enough for all cores.
WORK = 5000


def partitions(spark: SparkSession, work: float, units: float, per_task: float = WORK) -> int:
    """A number of partitions for so much work in so many units: two a core at least, if there are units, and no more than units."""
    return int(max(1, min(units, max(2 * spark.sparkContext.defaultParallelism, -(-work // per_task)))))


def by_unit(rows: DataFrame, unit: Sequence[str], order: str, before: Column, work: float, parts: int, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, series: Sequence[str] = ()) -> DataFrame:
    """run on the rows of each unit, in `order`; before: the work of the series' units ahead of a row's own, work: that of all."""
    start = F.pmod(F.xxhash64(*series), F.lit(parts)) if series else F.lit(0)
    place = F.pmod(start + F.floor(before * F.lit(parts / max(work, 1.0))), F.lit(parts)).cast("int")
    dealt = rows.repartitionById(parts, place).sortWithinPartitions(*unit, order)

    def units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for f in frames:
            # Hashes tell neighbouring units apart, nulls among their keys included.
            names = pd.util.hash_pandas_object(f[list(unit)], index=False).to_numpy()
            cuts = [0, *((names[1:] != names[:-1]).nonzero()[0] + 1).tolist(), len(f)]
            for a, b in zip(cuts, cuts[1:]):
                if held and names[a] != last:
                    yield run(pd.concat(held, ignore_index=True))
                    held.clear()
                held.append(f.iloc[a:b])
                last = names[a]
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(units, schema)
