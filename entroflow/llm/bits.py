"""Bitmaps of 64-bit keys for Python tasks: a bounded set of bits that tells most absent keys from the present ones.

A bitmap has at least 16 bits a key until MOST_BITS, and is broadcast: 64 MB at most, whatever the number of keys. A key
that is present always hits; others hit rarely, more often past some 30 million keys. Callers stay exact with any number
of false hits, which only cost them rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29


def bitmap_of(keys: DataFrame, column: str):
    """A broadcast of the bitmap (uint64 words) of a long column, with a power of two of bits that follows the number of keys."""
    n = keys.count()
    bits = min(max(LEAST_BITS, 1 << (16 * max(n, 1) - 1).bit_length()), MOST_BITS)
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    word, bit = F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    out = np.zeros(bits >> 6, np.uint64)
    if n:
        found = keys.groupBy(word).agg(F.bit_or(bit).alias("mask")).toArrow()
        out[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def hits(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (int64) may be in the bitmap."""
    at = keys.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def row_ids() -> Iterator[int]:
    """Numbers for a task's rows, different between the tasks of a stage and the same when one runs again."""
    at = TaskContext.get().partitionId() << 33
    while True:
        yield at
        at += 1


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))
