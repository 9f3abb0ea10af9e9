"""From raw documents to token ids: quality, near duplicates, benchmark leaks, personal data, encoding.

Every stage is one operator of ``contrastry.llm`` on all rows that the stage before kept; its
result is written as Parquet under the shared folder and read again, so a stage that loses
executors only repeats itself. All stages but the last return the columns of ``documents``.

Defined results: documents without words are rejected by the first stage; different texts that
share an id, or have none, are documents of their own; of repeated rows one stays; columns beyond those
of ``documents`` are dropped; an empty table runs through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.llm import bpe, decontaminate, feistel, jaccard, linequality
from contrastry.llm.inputs import table
from contrastry.session import materialize, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The stages hash text in Python, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that lose too much, or fail the base rules, go whole."""
    judged = linequality.judge(docs.select(*COLUMNS)).where("kept")
    return judged.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one row stays: that of the smallest id, then of the smallest text hash.

    Rows are told apart by a hash of (id, text), not by the id: texts under one id, or under none,
    are documents of their own. Only keys are grouped to choose; should two rows share a key, both stay.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_key"))
    classes = materialize(jaccard.jaccard_classes(keyed.select(F.col("row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "component_id").distinct(), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_key"), "row_key")
    chosen = keyed.select("row_key", order.alias("order")).join(classes, "row_key").groupBy("component_id").agg(F.min("order").alias("first")).select("first.row_key")
    kept = keyed.join(chosen, "row_key", "left_semi").groupBy("row_key", "doc_id", "text").agg(*[F.min(c).alias(c) for c in COLUMNS[2:]])
    return kept.select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one a few words away, go."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format."""
    return feistel.pseudonymise(docs.select(*COLUMNS)).drop("n_pseudonyms").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_leaks),
    ("PII", personal_data), ("BPE encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"corpus-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
