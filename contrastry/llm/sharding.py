"""Sharding over fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into a fixed number of virtual slots, bytes are aggregated per slot, and a
small map says which shard owns a slot. Version 0 deals the slots round-robin; rebalancing
edits the map (moves as few slots as it can) and writes the next version, so records never
have to be hashed again and an old layout can be read with its old map. The map has one row
per slot: its size is a parameter and does not grow with the data.

Defined results: NULL texts count as empty, NULL ids hash by their text, repeated rows share a
slot (and each gets its own place in the shard), an empty table gives an empty layout. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from contrastry.llm.inputs import table
from contrastry.session import materialize, scratch_path

VIRTUAL_SLOTS = 4096
SHARDS = 8


def slotted(docs: DataFrame, slots: int = VIRTUAL_SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, checksum and virtual slot of each record."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).alias("doc_id"), F.octet_length(body).cast("long").alias("bytes"), F.crc32(body).alias("text_crc32")).select(
        "doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.pmod(F.xxhash64("doc_id", "text_crc32", "bytes"), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_loads(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def first_map(slots: int, shards: int) -> list[int]:
    return [slot % shards for slot in range(slots)]


def rebalanced(owner: list[int], loads: dict[int, int], shards: int) -> list[int]:
    """The map after moving slots from the fullest to the emptiest shard while that evens them out."""
    owner = list(owner)
    totals = [0] * shards
    members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        totals[shard] += loads.get(slot, 0)
        if loads.get(slot, 0):
            members[shard].append((loads[slot], slot))
    for _ in range(len(owner) * 4):
        full, empty = totals.index(max(totals)), totals.index(min(totals))
        gap = totals[full] - totals[empty]
        movable = [m for m in members[full] if m[0] < gap]
        if not movable:
            break
        load, slot = min(movable, key=lambda m: (abs(2 * m[0] - gap), m[1]))
        members[full].remove((load, slot))
        members[empty].append((load, slot))
        owner[slot] = empty
        totals[full] -= load
        totals[empty] += load
    return owner


def write_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Add one version of the map to the table at ``path``."""
    rows = [(version, slot, shard) for slot, shard in enumerate(owner)]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version of the map, or the latest."""
    maps = spark.read.schema("version int, virtual_slot int, shard int").parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def layout(records: DataFrame, owners: DataFrame, loads: DataFrame) -> DataFrame:
    """Shard and gapless place of each record: the slots of a shard follow one another, so only
    records of one virtual slot are ever sorted together."""
    starts = owners.join(loads, "virtual_slot").select(
        "virtual_slot", "shard", F.col("version").alias("map_version"),
        (F.sum("records").over(W.partitionBy("shard").orderBy("virtual_slot")) - F.col("records")).alias("start"),
    )
    within = F.row_number().over(W.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size"))
    return records.withColumn("place", within).join(starts, "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "virtual_slot", "map_version",
    )


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialize(slotted(table(spark, sf_dir, "documents")), "slotted")
    loads = materialize(slot_loads(records), "slot-loads")
    path = scratch_path(spark, "slot-map")
    owner = first_map(VIRTUAL_SLOTS, SHARDS)
    write_map(spark, path, 0, owner)
    # at most VIRTUAL_SLOTS rows, whatever the size of the corpus
    measured = {row["virtual_slot"]: row["bytes"] for row in loads.collect()}
    write_map(spark, path, 1, rebalanced(owner, measured, SHARDS))
    placed = layout(records, read_map(spark, path), loads)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


QUERIES = {"op7_virtual_slots": op7_virtual_slots}
SQL: dict[str, str] = {}
