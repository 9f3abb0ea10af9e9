"""Sinks: tables, manifests, graph exports and reports. Commit protocols make each write atomic."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from contrastry.operators.graph import EDGE, NODE
from contrastry.sources.listing import file_system


POINTER = "version long, folder string"


def _pointers(spark: SparkSession, path: str) -> list[Row]:
    """Versions that were published, the latest first."""
    try:
        return spark.read.schema(POINTER).json(f"{path}/_published").orderBy(F.col("version").desc(), F.col("folder").desc()).collect()  # one row a version
    except AnalysisException:
        return []  # nothing published yet


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), options: Mapping[str, str] | None = None) -> int:
    """Parquet (zstd), replaced as a whole; returns the version.

    The rows go to a folder of their own, and one line that names it is published last: until then,
    and for good if the write fails, readers of ``read_table`` find the version before. Older versions
    stay readable for those who have begun.

    ``partition_by`` suits low-cardinality cohort columns; ``sort_by`` clusters files so
    that look-ups skip row groups. Rows are not shuffled by the partition column: a hot
    cohort stays spread over all tasks.
    """
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    ordered = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    writer = ordered.write.option("compression", "zstd").options(**(options or {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{folder}")
    earlier = _pointers(spark, path)
    version = earlier[0]["version"] + 1 if earlier else 1
    spark.createDataFrame([(version, folder)], POINTER).coalesce(1).write.mode("append").json(f"{path}/_published")
    return version


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest published version, or the one asked for."""
    found = [p for p in _pointers(spark, path) if version in (None, p["version"])]
    if not found:
        raise FileNotFoundError(f"no such table or version under {path}")
    return spark.read.parquet(f"{path}/{found[0]['folder']}")


def write_lookup(df: DataFrame, path: str, key: str, *, spread: Sequence[str] = (), files: int | None = None) -> int:
    """A table for look-ups by ``key``: files hold neighbouring keys, and a side table says which.

    Rows are dealt by ranges of (key, *spread), so ``spread`` cuts a key with very many rows into
    several files. Bloom filters in the files rule out keys that fall between those present.
    """
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(files, key, *spread).sortWithinPartitions(key, *spread)
    version = write_table(dealt, path, options={f"parquet.bloom.filter.enabled#{key}": "true"})
    written = read_table(df.sparkSession, path, version)
    spans = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("least"), F.max(key).alias("greatest"))
    write_table(spans.coalesce(1), f"{path}/_spans/{version}")  # one row a file
    return version


def read_lookup(spark: SparkSession, path: str, key: str, *values: str, version: int | None = None) -> DataFrame:
    """Rows with one of the given keys; only files whose span holds one are opened."""
    latest = version or next((p["version"] for p in _pointers(spark, path)), None)
    table = read_table(spark, path, latest)
    inside = F.lit(False)
    for value in values:
        inside = inside | F.lit(value).between(F.col("least"), F.col("greatest"))
    chosen = [r.file for r in read_table(spark, f"{path}/_spans/{latest}").where(inside).select("file").collect()]  # files that hold the answer
    return (spark.read.schema(table.schema).parquet(*chosen) if chosen else table.limit(0)).where(F.col(key).isin(*values))


def append_runs(records: DataFrame, path: str) -> None:
    """Run records added to the log; a single record is one file, and nothing written before changes."""
    records.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_manifest(records: DataFrame, path: str) -> None:
    """Tab-separated id, filename, md5, size, state."""
    records.select(
        F.col("file_id").alias("id"), F.col("file_name").alias("filename"), F.col("md5sum").alias("md5"), F.col("file_size").alias("size"), F.lit("released").alias("state")
    ).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Header CSVs of the two graph tables."""
    nodes.select(*NODE).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.select(*EDGE).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def write_graph_bulk(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder per node label and edge type, with the import column names."""
    unique = nodes.groupBy("node_label", F.col("node_id").alias("id")).agg(*[F.min(c).alias(c) for c in ("name", "primary_site", "source")])
    unique.write.mode("overwrite").partitionBy("node_label").option("header", True).csv(f"{path}/nodes")
    edges.select(
        F.col("source_node_id").alias("source_id"), F.col("target_node_id").alias("target_id"), F.col("weight").try_cast("double").alias("weight"), "evidence_source", "edge_type"
    ).write.mode("overwrite").partitionBy("edge_type").option("header", True).csv(f"{path}/edges")


def write_report(summary: DataFrame, path: str) -> None:
    """Summary rows beside a mart, as JSON lines and CSV."""
    summary.write.mode("overwrite").json(f"{path}/json")
    flat = [f.name for f in summary.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    summary.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_files(df: DataFrame, path: str, *, folders: int = 64) -> None:
    """(name, value) rows as one file for each row, spread over tasks and a fixed number of folders.

    The partitioned text writer makes a folder for each name and one task writes all files of its rows.
    Here rows are dealt evenly by name however small the table is. A file gets its name when it is
    whole, so a task that runs again, or twice at once, leaves the same files.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # without a scheme the path belongs to Hadoop's default file system, for the tasks too
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    target = location.getFileSystem(spark._jsc.hadoopConfiguration())
    target.mkdirs(location)  # a delivery without files is an empty folder
    whole = target.makeQualified(location).toString()

    def written(batches):
        import pyarrow as pa

        system, root = file_system(whole)
        made = set()
        for batch in batches:
            names, values, dealt = (batch.column(c).to_pylist() for c in ("name", "value", "_folder"))
            for name, value, folder in zip(names, values, dealt):
                if folder not in made:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                hidden = f"{root}/{folder}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as out:
                    out.write(value.encode())
                system.move(hidden, f"{root}/{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"files": pa.array([len(names)], pa.int64())})

    dealt = df.select("name", "value", F.pmod(F.hash("name"), F.lit(folders)).alias("_folder")).repartition(tasks, "name")
    dealt.mapInArrow(written, "files long").agg(F.sum("files")).collect()
