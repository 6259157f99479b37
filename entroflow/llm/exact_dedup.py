"""Exact deduplication with a log-structured merge index of text digests, in DataFrame operations only.

Flush: every task is a memtable; it writes its digests, sorted, to the log. The log's files are dealt to MEMTABLES runs; a run
has one entry a digest, with the best row's id and the number of rows, aggregated within tasks before it shuffles, so a
hot group costs a row a task. A run has a filter, one bit a digest in at most FILTER_WORDS words.

Compaction: levels merge two by two, the older with the newer. The newer's digests are looked up in the older's filter, which
is broadcast; those that it doesn't hold are new and are appended as they are. The others merge by order (a sort-merge join
of entries that are unique on either side), and an entry keeps the better row, which is the smallest id among the longest,
and the sum of the rows. The merged level's filter is the union of both.

Hits: digests with more than one row feed a filter of the same kind; only texts that pass it are compared, byte by
byte: a group's texts are equal if the smallest and the largest are, which tasks work out on their own rows before they
shuffle. Groups whose texts differ under one digest are told apart by the text itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_of, likely_in, materialize, passed, table, united_filter

#: Runs that the log is flushed to.
MEMTABLES = 4
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def squeezed(text: Column) -> Column:
    """The text without characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _rank() -> Column:
    return F.struct(F.col("code_points"), -F.col("doc_id"))


@dataclass
class Level:
    """entries: key, keep_id, code_points, digest, group_size, one row a key; filter: the words of likely_in's filter of the keys."""

    entries: DataFrame
    filter: DataFrame


def log_of(rows: DataFrame) -> DataFrame:
    """Write the digests of rows to the log, sorted by key within a task, with the run that a task belongs to."""
    entry = rows.select("key", "digest", "doc_id", "code_points", (F.spark_partition_id() % MEMTABLES).alias("run"))
    return materialize(entry.sortWithinPartitions("key"), "dedup-log")


def flush(log: DataFrame) -> Level:
    """A run: for each key of these rows of the log the row that stays (most code points, then smallest id) and the number of rows."""
    merged = log.groupBy("key").agg(
        F.max_by("doc_id", _rank()).alias("keep_id"), F.max("code_points").alias("code_points"), F.max_by("digest", _rank()).alias("digest"), F.count(F.lit(1)).alias("group_size")
    )
    entries = materialize(merged, "dedup-run")
    return Level(entries, materialize(filter_of(entries, "key"), "dedup-filter"))


def compact(older: Level, newer: Level) -> Level:
    """One level of two."""
    new = passed(newer.entries, "key", older.filter)
    fresh = new.where("NOT passed").drop("passed")
    hits = new.where("passed").select("key", *[F.col(c).alias(f"new_{c}") for c in ("keep_id", "code_points", "digest", "group_size")])
    # Most code points, then the smallest id; a null id comes last, and a side without the key has null code points.
    mine, theirs = F.struct("code_points", -F.col("keep_id")), F.struct("new_code_points", -F.col("new_keep_id"))
    take = F.col("new_code_points").isNotNull() & (F.col("code_points").isNull() | (theirs > mine))
    rows = F.coalesce("group_size", F.lit(0)) + F.coalesce("new_group_size", F.lit(0))
    both = older.entries.hint("merge").join(hits, "key", "full")
    merged = both.select("key", *[F.when(take, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("keep_id", "code_points", "digest")], rows.alias("group_size"))
    return Level(materialize(merged.unionByName(fresh), "dedup-level"), materialize(united_filter(older.filter, newer.filter), "dedup-filter"))


def index(log: DataFrame) -> DataFrame:
    """The entries of the one level that all runs of the log are compacted to."""
    levels = [flush(log.where(F.col("run") == r)) for r in range(MEMTABLES)]
    while len(levels) > 1:
        levels = [compact(*levels[at : at + 2]) if at + 1 < len(levels) else levels[at] for at in range(0, len(levels), 2)]
    return levels[0].entries


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """Group rows of (doc_id, text) by equal text, white space aside, and name the row that stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row.
    Null text counts as empty, so null, empty and all-blank texts are one group. The row with the most code points
    stays, then the smallest doc_id; a null doc_id comes last. Rows that repeat a doc_id with the same text share
    their verdict (kept is doc_id = keep_id, null-safe). Other columns are ignored, an empty table gives an empty
    result. digest_bytes: leading bytes of SHA-256 that index the text; fewer only make more texts meet and be told
    apart by comparison.
    """
    text = squeezed(F.col("text"))
    rows = docs.select("doc_id", text.alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("code_points")).withColumn(
        "digest", F.unhex(F.sha2("norm", 256))
    )
    rows = rows.withColumn("key", F.col("digest") if digest_bytes == 32 else F.substring("digest", 1, digest_bytes))
    log = log_of(rows)
    level = index(log)
    hits = level.where("group_size > 1").select("key", "keep_id", "group_size")
    compared = likely_in(rows.select("key", "norm"), "key", hits).groupBy("key").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    mixed = materialize(compared.where("low <> high").select("key"), "dedup-mixed-keys")

    single = level.where("group_size = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", "digest")
    several = likely_in(log.select("key", "doc_id", "digest"), "key", hits).join(hits, "key")
    if mixed.isEmpty():
        found = single.unionByName(several.drop("key"))
    else:
        clashes = likely_in(rows, "key", mixed).join(mixed, "key")
        own = clashes.groupBy("key", "norm").agg(F.max_by("doc_id", _rank()).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = clashes.select("doc_id", "digest", "key", "norm").join(own, ["key", "norm"]).select(single.columns)
        found = single.unionByName(several.join(mixed, "key", "left_anti").drop("key")).unionByName(apart)
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
