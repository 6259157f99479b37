"""Table functions for SQL text.

    SELECT * FROM surrogate_series(TABLE(t) PARTITION BY (series, win) ORDER BY (idx), 'iaaft', 100, 0)
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions import surrogates


class SurrogateSeries:
    """Surrogates of each partition's series: key, replicate, at (from 0), value.

    The table's first column is text that names the series, the second its values in order; null is a gap and stays where it
    is. A partition is held in one task, so it should be a window and not a series that grows. The same key, seed and values
    give the same surrogates on any cluster. A series that the method can't work on (empty, or all gaps) has no rows.
    """

    def __init__(self):
        self.key, self.values, self.arguments = None, [], None

    def eval(self, row, kind: str, n: int, seed: int):
        self.key, self.arguments = row[0], (kind, n, seed)
        self.values.append(np.nan if row[1] is None else float(row[1]))

    def terminate(self):
        if self.arguments and not np.isnan(self.values).all():
            kind, n, seed = self.arguments
            name = zlib.crc32((self.key or "").encode())
            drawn = surrogates.replicates(np.array(self.values)[:, None], kind, [np.random.default_rng([seed, name, i]) for i in range(n)])
            for i, series in enumerate(drawn[:, :, 0]):
                for at, v in enumerate(series.tolist()):
                    yield self.key, i, at, None if np.isnan(v) else v


def register(spark: SparkSession) -> None:
    """Name the table functions for SQL text: surrogate_series(TABLE(key, value), kind, n, seed)."""
    spark.udtf.register("surrogate_series", udtf(SurrogateSeries, returnType="key string, replicate int, at int, value double"))
