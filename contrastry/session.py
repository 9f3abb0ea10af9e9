"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

INFERENCE = "spark.sql.constraintPropagation.enabled"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would vanish with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="spark-contrastry-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


#: While schemas alone are asked for: those of the tables planned so far, by name.
_PLANNED: list[dict] = []


@contextmanager
def schemas_only() -> Iterator[None]:
    """Tables that would be written are only planned inside: they have their columns and no rows."""
    _PLANNED.append({})
    try:
        yield
    finally:
        _PLANNED.pop()


def planned() -> dict | None:
    return _PLANNED[-1] if _PLANNED else None


def materialize(df: DataFrame, label: str = "stage", *, inferred: bool = True) -> DataFrame:
    """Cut lineage with a written table; survives the loss of any executor.

    ``inferred=False`` plans the job without inferred filters: over expressions of many columns
    Spark derives one for every combination of their aliases.
    """
    if planned() is not None:
        return df.sparkSession.createDataFrame([], df.schema)
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(INFERENCE, "true")
    if not inferred:
        spark.conf.set(INFERENCE, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(INFERENCE, before)
    return spark.read.schema(df.schema).parquet(path)
