"""Shared pieces of the training-data operators: inputs, scratch tables, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's memo of words or fragments holds before it starts afresh.
MEMO_ENTRIES = 500_000
#: The same for hashes of words, which are quick to compute again.
HASH_ENTRIES = 150_000
#: Bytes of a word beyond which its hash isn't kept: texts without spaces have words of any length.
HASH_BYTES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the setting is absent, as in tests on one machine, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="entroflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, read back, and its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    return scratch_table(df, label, **options)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that nothing reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Meanwhile the session has these settings."""
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: A job's shuffle files go when it ends, and don't add up over the jobs of an operator.
NO_OLD_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """Meanwhile Arrow batches hold at most so many rows (and bytes), which bounds what the JVM and a worker hold of whole texts."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} | ({"spark.sql.execution.arrow.maxBytesPerBatch": str(size)} if size else {})
    with configured(spark, settings):
        yield


_CACHE: dict = {}


def worker_cache(key, make):
    """What make() returns, kept by a worker while it serves tasks of the same key.

    A worker serves many operators one after another; it keeps one such object at a time, so that their sizes don't
    add up.
    """
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = make()
    return _CACHE[key]


class WordHashes(dict):
    """Memo from a word's bytes to its 64-bit hash as a signed integer."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        h = h - (1 << 64) if h >> 63 else h
        if len(word) <= HASH_BYTES:
            if len(self) >= HASH_ENTRIES:
                self.clear()
            self[word] = h
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; bytes methods touch ASCII only."""
    return text.encode().lower().split() if text else []


def small_batches(batches, rows: int = 1000):
    """The same Arrow batches in slices of so many rows, which bounds what a worker holds at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: 64-bit words of a row filter; it is broadcast, and so many rows are its most.
FILTER_WORDS = 1 << 16


def _bit(key: str) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)), F.expr(f"shiftleft(1L, cast(xxhash64({key}) & 63 as int))")


def filter_of(keys: DataFrame, key: str) -> DataFrame:
    """The words (_word, _mask) of a row filter that holds these keys: one bit a key, at most FILTER_WORDS rows."""
    word, bit = _bit(key)
    return keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_mask"))


def united_filter(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))


def passed(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """rows with `passed`: whether their key may be among those of a filter, which is broadcast."""
    word, bit = _bit(key)
    found = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return found.withColumn("passed", F.coalesce(F.col("_mask").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_mask")


def likely_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among keys (a table with that column): all that are, and few others.

    The filter is one bit a key in at most FILTER_WORDS broadcast rows, whatever the size of keys; it spares the
    shuffle of rows that a join on the key would drop.
    """
    word, bit = _bit(key)
    return rows.withColumn("_word", word).join(F.broadcast(filter_of(keys, key)), "_word").where(F.col("_mask").bitwiseAND(bit) != 0).drop("_word", "_mask")
