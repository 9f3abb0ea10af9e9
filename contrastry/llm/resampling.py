"""Importance resampling towards a target distribution, on hashed word n-grams.

A batch's texts are joined with a separator sentinel, one regex pass finds all their words, and
``searchsorted`` on the offsets of the documents tells which document a word belongs to, so that
n-grams across documents are masked before ``bincount``. Two passes over the corpus: the first
counts features by bucket (one bounded array for each task, summed by Spark), the second weighs
every document by the mean gain of its features. What is gathered is one number for each bucket,
a parameter that does not grow with the data.

The draw is Gumbel top-k: weight plus a Gumbel variate hashed from the document's id, so that a
rerun draws the same documents; ranks come from a range-dealt global order.

Defined results: NULL, empty and wordless texts have no features, weight 0 and no rank; a NULL id
hashes like an empty one and comes last among ties; repeated rows are each counted, scored and
ranked; an empty corpus or an empty target is a total of 0 features. Texts of any length are read
whole. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.functions.ordered import ordered_rank
from contrastry.llm.batches import slices
from contrastry.llm.inputs import table
from contrastry.session import materialize

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: A word of a lower-cased UTF-8 text, and the sentinel between texts, which no word holds.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTINEL = b"\x00"

WEIGHED = "doc_id long, n_words long, n_features long, weight long"


class Features:
    """Bucket and document of every word n-gram of a column of texts."""

    def __init__(self, column: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS):
        texts = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
        self.rows = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, self.rows)
        offsets = np.cumsum(lengths + 1) - lengths - 1
        found = list(WORD.finditer(SENTINEL.join(texts).lower()))
        words = [m[0] for m in found]
        self.document = np.searchsorted(offsets, np.fromiter((m.start() for m in found), np.int64, len(found)), "right") - 1
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        sums: list[int] = list(map(crc32, words))
        for size in range(1, longest + 1):
            if size > 1:
                # a checksum goes on where the shorter n-gram's has stopped
                sums = list(map(crc32, words[size - 1:], map(crc32, repeat(b" "), sums)))
            last = self.document[size - 1:]
            inside = self.document[:len(last)] == last
            self.parts.append((np.array(sums, np.int64)[inside] % buckets, last[inside]))

    def counted(self, buckets: int = BUCKETS) -> np.ndarray:
        return sum(np.bincount(bucket, minlength=buckets) for bucket, _ in self.parts)

    def weighed(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and floored mean gain of each document."""
        counts = [np.bincount(document, minlength=self.rows) for _, document in self.parts]
        total = np.zeros(self.rows, np.int64)
        for bucket, document in self.parts:
            np.add.at(total, document, gains[bucket])
        features = sum(counts)
        return counts[0], features, np.where(features > 0, total // np.maximum(features, 1), 0)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket that holds any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in slices(batches, text):
            held += Features(batch.column(0), longest, buckets).counted(buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    return texts.select(F.col(text)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): smoothed log ratio of a bucket's share in the target to that in the corpus, in thousandths."""
    joined = (
        spark.range(buckets).withColumnRenamed("id", "bucket")
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    )
    all_s, all_t = (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for counts in (corpus, target))
    ratio = ((F.col("t").cast("double") + 1) * float(all_s + buckets)) / ((F.col("s").cast("double") + 1) * float(all_t + buckets))
    return joined.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, gains: np.ndarray, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """Words, features and weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words, features, weight = Features(batch.column(text), longest, len(shared.value)).weighed(shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, WEIGHED)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """A Gumbel variate hashed from the key, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", *, buckets: int = BUCKETS, longest: int = LONGEST,
             least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every row with its weight and score, and the rank of those drawn."""
    spark = docs.sparkSession
    corpus, wanted = bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets)
    gains = np.zeros(buckets, np.int64)
    for row in bucket_gains(spark, materialize(corpus, "bucket-counts"), materialize(wanted, "target-counts"), buckets).collect():  # one row a bucket
        gains[row["bucket"]] = row["gain"]
    scored = materialize(weighed(docs, gains, text, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weighed")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    ranked = ordered_rank(eligible, [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("long"))
    return ranked.withColumn("rank", rank).unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


# The checksum in SQL: CRC-32 is linear, so a feature's is the exclusive or of what each byte adds
# at its distance from the end, and of a constant for the length.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH RECURSIVE bits(byte, step, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8
), one AS MATERIALIZED (SELECT byte, c FROM bits WHERE step = 8),
texts AS MATERIALIZED (
  SELECT true AS own, doc_id, row_number() OVER () AS row, {_WORDS} AS w FROM documents
  UNION ALL
  SELECT false, item_id, row_number() OVER (), {_WORDS} FROM benchmark
), features AS MATERIALIZED (
  SELECT own, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts
), hexed AS MATERIALIZED (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)
), effect(distance, byte, c) AS (
  SELECT 0, byte, c FROM one
  UNION ALL
  SELECT e.distance + 1, e.byte, xor(o.c, e.c >> 8) FROM effect e JOIN one o ON o.byte = e.c & 255 WHERE e.distance < (SELECT max(length(h)) // 2 FROM hexed)
), start(size, c) AS (
  SELECT 0, 4294967295::BIGINT
  UNION ALL
  SELECT s.size + 1, xor(o.c, s.c >> 8) FROM start s JOIN one o ON o.byte = s.c & 255 WHERE s.size < (SELECT max(length(h)) // 2 FROM hexed)
), bytes AS (
  SELECT f, length(h) // 2 AS size, unnest(range(1, length(h), 2)) AS at, h FROM hexed
), linear AS (
  SELECT b.f, b.size, bit_xor(e.c) AS c
  FROM bytes b JOIN effect e ON e.distance = b.size - 1 - (b.at - 1) // 2 AND e.byte = ('0x' || substr(b.h, b.at, 2))::BIGINT
  GROUP BY ALL
), bucket_of AS MATERIALIZED (
  SELECT l.f, xor(xor(l.c, s.c), 4294967295) % 10000 AS bucket FROM linear l JOIN start s USING (size)
), placed AS MATERIALIZED (SELECT own, row, bucket FROM features JOIN bucket_of USING (f)),
held AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM placed GROUP BY bucket),
totals AS (SELECT count(*) FILTER (own) AS all_s, count(*) FILTER (NOT own) AS all_t FROM placed),
gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM held, totals
), summed AS (SELECT row, count(*) AS n, sum(gain) AS g FROM placed JOIN gains USING (bucket) WHERE own GROUP BY row),
scored AS (
  SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(s.n, 0)::BIGINT AS n_features,
    coalesce((s.g - ((s.g % s.n) + s.n) % s.n) // s.n, 0)::BIGINT AS weight,
    floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('7:' || coalesce(t.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM texts t LEFT JOIN summed s USING (row) WHERE t.own
), ordered AS (
  SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS eligible
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank, n_words FROM ordered
"""

QUERIES = {"op12_importance_resampling": op12_importance_resampling}
SQL = {"op12_importance_resampling": OP12_SQL}
