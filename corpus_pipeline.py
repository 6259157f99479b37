"""A training corpus from `documents`: good rows that hold text, without exact and near copies, packed into sequences.

Each stage works on all rows that the one before kept, and is written as Parquet to the shared folder and read again, so
a lost executor costs the running stage at most. Stages hold the rows' columns as they are; the last returns pieces.
A document is identified by doc_id: of rows that repeat one with equal text exact dedup keeps one, and rows that repeat
one with other texts share its near-duplicate verdict; rows without a doc_id differ by text. Null texts are empty, and are judged, in turn, by their (zero) quality features, as of no language,
and as copies of each other. Columns of any name beside doc_id, text and lang are carried along.

The language stage drops rows without a verdict of op1, i.e. texts without a letter (all rows if no language was
learned). Any other text has the learned language that fits it best, so a text in another language, or junk with letters,
stays: the stage doesn't reject by entropy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entroflow.llm import exact_dedup, language, minhash, packing, quality
from entroflow.llm.common import materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.train(docs))


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    stay = verdicts.where("kept").select("doc_id")
    return docs.join(stay, docs.doc_id.eqNullSafe(stay.doc_id), "left_semi")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one that exact dedup names; of rows that repeat its doc_id, the longest one, then the first text."""
    verdicts = exact_dedup.exact_dedup(docs).where("kept").select("doc_id", "text_sha256", "group_size").distinct()
    own = docs.withColumn("_sha", F.sha2(exact_dedup.squeezed(F.col("text")), 256))
    found = own.join(verdicts.withColumnRenamed("doc_id", "_id"), own.doc_id.eqNullSafe(F.col("_id")) & (own["_sha"] == F.col("text_sha256"))).drop("_id", "text_sha256")
    # Rows of one doc_id and text are in groups of several, of which these are the kept ones.
    best = Window.partitionBy("doc_id", "_sha").orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))), "text")
    several = found.where("group_size > 1").withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")
    return found.where("group_size = 1").unionByName(several).drop("_sha", "group_size")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, minhash.near_duplicates(docs, width=5))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("packing", packed),
]

#: The classifiers, the tokenizer and the packing aren't expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
