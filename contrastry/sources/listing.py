"""Files as rows: names, sizes, digests of their bytes, and what changed between two listings.

Built-in file sources put a whole file into one row, which ends at 2 GB and fills a task's
memory well before. Here Spark lists names and sizes only; tasks then read each file in pieces.
A task that is lost hashes its files again from their beginning.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PIECE = 1 << 20
STAMP = ("path", "length", "modified")


def listed_files(spark: SparkSession, path: str, *, name: str = r"([^/]+)$") -> DataFrame:
    """(path, file_name, length, modified) of the files under a folder; contents are not read.

    Spark's listing leaves out files without bytes, so an empty delivery counts as absent.
    ``name`` takes the file's name out of its path: tables that Spark wrote hold theirs in a folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", name, 1).alias("file_name"), "length", F.col("modificationTime").alias("modified"))


def latest_delivery(spark: SparkSession, path: str) -> str:
    """Of the folders under ``path``, that with the file written last; of equal times the last name.

    A delivery of a distributed job is a folder of many files, written over some time, so the
    folder is dated by its newest file and taken whole. Only the listing is read.
    """
    folder = F.regexp_extract("path", re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/([^/]+)/", 1)
    newest = listed_files(spark, path).select(folder.alias("folder"), "modified").where(F.col("folder") != "").agg(F.max(F.struct("modified", "folder")).alias("last")).first()
    if newest.last is None:
        raise FileNotFoundError(f"no delivery under {path}")
    return f"{path.rstrip('/')}/{newest.last.folder}"


def file_system(path: str):
    """The Arrow file system of a path, and the path inside it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _digest(path: str, algorithm: str) -> str:
    system, inner = file_system(path)
    state = hashlib.new(algorithm)
    with system.open_input_stream(inner) as stream:
        while piece := stream.read(PIECE):
            state.update(piece)
    return state.hexdigest()


def with_digests(files: DataFrame, *, algorithm: str = "md5") -> DataFrame:
    """The listing with the digest of every file, in a column named after the algorithm."""

    def hashed(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            yield batch.append_column(algorithm, pa.array([_digest(p, algorithm) for p in batch.column("path").to_pylist()], pa.string()))

    return files.mapInArrow(hashed, StructType([*files.schema.fields, StructField(algorithm, StringType())]))


def refreshed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Digests of a new listing; files whose size and time are those of ``known`` are not read again."""
    spark = files.sparkSession
    seen = files.join(known.select(*STAMP, "md5").distinct(), list(STAMP), "left")
    # rows are tiny and their work is not: a number of partitions that is given stays as it is
    stale = seen.where(F.col("md5").isNull()).select(*files.columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return seen.where(F.col("md5").isNotNull()).select(*files.columns, "md5").unionByName(with_digests(stale))


def changes(before: DataFrame, after: DataFrame, key: str = "file_name") -> DataFrame:
    """Every file of two listings as added, removed, changed or unchanged."""
    old, new = (df.select(key, F.col("md5").alias(c), F.lit(True).alias(f"_{c}")) for df, c in ((before, "md5_before"), (after, "md5_after")))
    kind = (
        F.when(F.col("_md5_before").isNull(), "added").when(F.col("_md5_after").isNull(), "removed")
        .when(F.col("md5_before").eqNullSafe(F.col("md5_after")), "unchanged").otherwise("changed")
    )
    return old.join(new, key, "full").select(key, kind.alias("change"), "md5_before", "md5_after")


def require_unchanged(before: DataFrame, after: DataFrame) -> None:
    """Refuse to go on with inputs that are not those of the frozen listing."""
    if changes(before, after).where("change <> 'unchanged'").limit(1).count():
        raise ValueError("input files differ from the frozen listing; start a new study")
