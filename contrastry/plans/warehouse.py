"""Conformed tables and marts written once per session under the shared folder.

Marts are inputs of other marts, exactly as in a batch lakehouse: each is built
by one job and written as Parquet, which also cuts lineage (a lost executor only
re-reads files). A query named after a mart always computes it afresh; only its
*inputs* come from here.

What a mart was built from, other marts included, is noted while it is built. ``refresh``
compares the input files with those of that time and forgets the marts that are stale.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from contrastry.session import planned, scratch_path
from contrastry.sources.listing import listed_files


@dataclass
class Stored:
    path: str = ""
    inputs: dict[str, tuple] = field(default_factory=dict)  # table path -> its files when the mart was built


_STORED: dict[tuple[str, str, str], Stored] = {}
_SEEN: dict[tuple[str, str], tuple] = {}
_BUILDING: list[Stored] = []


def _files(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of a table's files; one small job that reads no contents."""
    return tuple(sorted((r.path, r.length, str(r.modified)) for r in listed_files(spark, path).drop("file_name").collect()))


def reads(spark: SparkSession, path: str) -> None:
    """Note that the marts being built read the table at ``path``."""
    if _BUILDING:
        key = (spark.sparkContext.applicationId, path)
        if key not in _SEEN:
            _SEEN[key] = _files(spark, path)
        for entry in _BUILDING:
            entry.inputs[path] = _SEEN[key]


def once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], object]) -> str:
    """The folder that ``write`` filled on first use in this application, or after its inputs changed."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    if key not in _STORED:
        entry = Stored(scratch_path(spark, name))
        _BUILDING.append(entry)
        try:
            write(entry.path)
        finally:
            _BUILDING.pop()
        _STORED[key] = entry
    for parent in _BUILDING:
        parent.inputs.update(_STORED[key].inputs)
    return _STORED[key].path


def held(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether the table ``name`` is stored already."""
    return (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name) in _STORED


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The table ``name`` for ``sf_dir``; inside ``schemas_only`` a table not yet stored is planned and not built."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    schemas = planned()
    if schemas is not None and key not in _STORED:
        if key not in schemas:
            schemas[key] = build(spark, sf_dir).schema
        return spark.createDataFrame([], schemas[key])
    return spark.read.parquet(once(spark, sf_dir, name, lambda to: build(spark, sf_dir).write.parquet(to)))


def refresh(spark: SparkSession) -> list[str]:
    """Forget marts whose input files changed, went or came; they are built anew on next use. Returns their names.

    Their folders stay until the shared folder is cleared: tables read earlier may still point there.
    """
    app = spark.sparkContext.applicationId
    for key in [k for k in _SEEN if k[0] == app]:
        _SEEN[key] = _files(spark, key[1])
    stale = [k for k, entry in _STORED.items() if k[0] == app and any(_SEEN[app, path] != files for path, files in entry.inputs.items())]
    for key in stale:
        del _STORED[key]
    return sorted(name for _, _, name in stale)


def mart(name: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Decorator: the function then returns the stored table; ``.fresh`` computes it."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        def read(spark: SparkSession, sf_dir: str) -> DataFrame:
            return stored(spark, sf_dir, name, build)

        read.fresh = build
        read.__name__, read.__doc__ = build.__name__, build.__doc__
        return read

    return wrap


def selection(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Decorator: a cheap selection of a stored table, planned on each use and never copied."""
    build.fresh = build
    return build
