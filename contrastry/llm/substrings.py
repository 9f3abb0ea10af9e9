"""Removing passages that repeat across or inside documents, exactly, behind a count-min sketch.

A window is 20 consecutive words. Windows are addressed by their anchor: the word 10-gram with
the smallest hash among the eleven in the window, so equal windows have equal anchors at equal
places, and only about one position in six is an anchor. First pass: every partition sketches
its anchors (two rows of cells, counting to two); the partial sketches are merged by range of
cells. A cell is at least as full as each of its anchors is frequent, so an anchor that occurs
twice is never missed. Second pass: windows whose anchor may be repeated, and no others, go
through the shuffle and are grouped exactly; every window but the earliest marks its words.
The marks return to the documents as ranges of words.

The merged sketch is broadcast: ``2 * CELLS`` bits, 32 MB, whatever the corpus. Beyond some
tens of millions of anchors it fills up and lets more unique windows through to the exact
grouping; that costs shuffle, never results.

Defined results: a window is removed when the same words start earlier, by smaller doc_id or
by place in the same document, judged on the input alone. NULL ids come after all others;
documents that share an id are ordered by a hash of their text; repeated rows (same id, same
text) count as one document and repeat its result. NULL and empty texts have no words. Only
the two named columns are read. Windows are grouped by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.llm.batches import slices
from contrastry.llm.inputs import table
from contrastry.llm.wordhash import Words, mix
from contrastry.session import materialize

WINDOW = 20
ANCHOR = 10
#: Cells of each of the two rows of the sketch.
CELLS = 1 << 27
SEEDS = (3, 5)
CHUNK_WINDOWS = 1_000_000
NO_ID = np.iinfo(np.int64).max

PARTIAL = "shard int, row int, once binary, twice binary"
MERGED = "shard int, row int, bits binary"
PACKED = "bucket int, chunk long, payload binary"
MARKED = "chunk long, kind int, payload binary"
RANGES = "doc_id long, text_key long, ranges binary"


def smallest(hashes: np.ndarray, span: int) -> np.ndarray:
    """Place of the first smallest hash among the ``span`` from each place on."""
    at = np.arange(len(hashes))
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] < hashes[left], right, left)
        reach += step
    return at


def windows_of(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie inside one document, the place and hash of their anchors."""
    grams = words.grams(anchor)
    if len(grams) <= window - anchor:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = smallest(grams, window - anchor + 1)
    document = np.repeat(np.arange(len(words.first) - 1), words.counts())
    start = np.flatnonzero(document[:len(place)] == document[window - 1:window - 1 + len(place)])
    return start, place[start], grams[place[start]]


def cells_of(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(mix(anchors + np.uint64(seed)) % np.uint64(cells)).astype(np.uint32) for seed in SEEDS]


def sketch_partition(text: str, window: int, anchor: int, cells: int, shards: int):
    """The partition's sketch as sorted cells, cut into ranges: those hit, and those hit twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = [[], []]
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row, parts in enumerate(rows):
                hit, count = np.unique(np.concatenate(parts), return_counts=True)
                twice = hit[count > 1]
                limits = np.arange(1, shards) * (cells // shards)
                for shard, (a, b) in enumerate(zip(np.split(hit, np.searchsorted(hit, limits)), np.split(twice, np.searchsorted(twice, limits)))):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([row], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()),
                    ], ["shard", "row", "once", "twice"])
                parts.clear()

        for batch in slices(batches, text):
            _, place, _ = windows_of(words := Words(batch.column(text)), window, anchor)
            if len(place):
                for row, hit in enumerate(cells_of(words.grams(anchor)[np.unique(place)], cells)):
                    rows[row].append(hit)
                held += len(place)
            if held > 16 * CHUNK_WINDOWS:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    return run


def merge_sketches(cells: int, shards: int):
    """Ranges of the merged sketch, one bit a cell: counted twice or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for batch in batches:
            for shard, row, once, twice in zip(*(batch.column(c).to_pylist() for c in ("shard", "row", "once", "twice"))):
                held = parts.setdefault((shard, row), ([], []))
                held[0].append(np.frombuffer(once, np.uint32))
                held[1].append(np.frombuffer(twice, np.uint32))
        for (shard, row), (once, twice) in parts.items():
            low = shard * (cells // shards)
            size = cells - low if shard == shards - 1 else cells // shards
            hit, count = np.unique(np.concatenate(once), return_counts=True)
            full = np.zeros(size, bool)
            full[hit[count > 1] - low] = True
            full[np.concatenate(twice) - low] = True
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([row], pa.int32()), pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())], ["shard", "row", "bits"])

    return run


def merged_sketch(docs: DataFrame, text: str, window: int, anchor: int, cells: int) -> bytes:
    """Both rows of the merged sketch, one after the other: 2 * cells bits."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(64, cells // 8)
    partial = docs.select(text).mapInArrow(sketch_partition(text, window, anchor, cells, shards), PARTIAL)
    merged = partial.repartition(max(shards, partitions), "shard", "row").mapInArrow(merge_sketches(cells, shards), MERGED)
    out = np.zeros(2 * cells // 8, np.uint8)
    for piece in merged.toLocalIterator():  # 2 * cells bits in all, whatever the corpus
        at = piece["row"] * cells // 8 + piece["shard"] * (cells // shards) // 8
        bits = np.frombuffer(piece["bits"], np.uint8)
        out[at:at + len(bits)] = bits
    return out.tobytes()


def maybe_repeated(sketch: np.ndarray, anchors: np.ndarray, cells: int) -> np.ndarray:
    hit = np.ones(len(anchors), bool)
    for row, at in enumerate(cells_of(anchors, cells)):
        at = at.astype(np.int64) + row * cells
        hit &= (sketch[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def pack_windows(sketch, text: str, window: int, anchor: int, cells: int, buckets: int):
    """Windows that may be repeated, by bucket of their hash: for each bucket of a chunk the documents,
    the windows of each, their starts and hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sketch.value, np.uint8)
        ids, keys, owners, starts, hashes, number = [], [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc_id, text_key = np.concatenate(ids), np.concatenate(keys)
            owner, start, value = np.concatenate(owners), np.concatenate(starts), np.concatenate(hashes)
            place = np.uint64(TaskContext.get().partitionId() * 1_000_003 + number)
            chunk = int(mix(np.array([np.bitwise_xor.reduce(mix(text_key.view(np.uint64) + np.arange(len(doc_id), dtype=np.uint64))) + place], np.uint64)).view(np.int64)[0])
            bucket = ((value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets < 65536 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                part = order[edges[b]:edges[b + 1]]
                if len(part):
                    docs_here, count = np.unique(owner[part], return_counts=True)
                    payload = (np.array([len(docs_here), len(part)], np.int64).tobytes() + doc_id[docs_here].tobytes() + text_key[docs_here].tobytes()
                               + count.astype(np.int64).tobytes() + value[part].tobytes() + start[part].astype(np.uint32).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([chunk], pa.int64()), pa.array([payload], pa.binary())], ["bucket", "chunk", "payload"])

        docs_held = windows_held = 0
        for batch in slices(batches, text):
            words = Words(batch.column(text))
            start, _, anchors = windows_of(words, window, anchor)
            hit = maybe_repeated(bits, anchors, cells)
            start = start[hit]
            owner = np.searchsorted(words.first, start, "right") - 1
            ids.append(np.asarray(batch.column("doc_id").fill_null(NO_ID)))
            keys.append(np.asarray(batch.column("text_key")))
            owners.append(owner + docs_held)
            starts.append(start - words.first[owner])
            hashes.append(words.spans(start, start + window))
            docs_held += batch.num_rows
            windows_held += len(start)
            if windows_held >= CHUNK_WINDOWS:
                yield from flush()
                ids, keys, owners, starts, hashes, number = [], [], [], [], [], number + 1
                docs_held = windows_held = 0
        if windows_held:
            yield from flush()

    return run


def mark_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group the windows of a bucket exactly; return to each chunk the starts of all but the earliest."""
    chunks, docs, keys, counts, values, starts = [], [], [], [], [], []
    for batch in batches:
        for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist()):
            size, total = np.frombuffer(payload, np.int64, 2).tolist()
            docs.append(np.frombuffer(payload, np.int64, size, 16))
            keys.append(np.frombuffer(payload, np.int64, size, 16 + 8 * size))
            counts.append(np.frombuffer(payload, np.int64, size, 16 + 16 * size))
            values.append(np.frombuffer(payload, np.uint64, total, 16 + 24 * size))
            starts.append(np.frombuffer(payload, np.uint32, total, 16 + 24 * size + 8 * total))
            chunks.append(np.full(size, chunk, np.int64))
    if not chunks:
        return
    chunk, doc_id, text_key, count = (np.concatenate(x) for x in (chunks, docs, keys, counts))
    owner = np.repeat(np.arange(len(count)), count)
    value, start = np.concatenate(values), np.concatenate(starts)
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    twin = np.zeros(len(ranked), bool)
    twin[1:] |= ranked[1:] == ranked[:-1]
    twin[:-1] |= ranked[1:] == ranked[:-1]
    order = order[twin]  # the rest is unique after all
    order = order[np.lexsort((start[order], text_key[owner[order]], doc_id[owner[order]], value[order]))]
    value, start, owner = value[order], start[order], owner[order]
    if not len(value):
        return
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    head = np.repeat(first, np.diff(np.concatenate([first, [len(value)]])))
    later = (doc_id[owner] != doc_id[owner[head]]) | (text_key[owner] != text_key[owner[head]]) | (start != start[head])
    owner, start = owner[later], start[later]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    for part in np.split(np.arange(len(owner)), np.flatnonzero(chunk[owner[1:]] != chunk[owner[:-1]]) + 1) if len(owner) else []:
        docs_here, sizes = np.unique(owner[part], return_counts=True)
        payload = np.array([len(docs_here)], np.int64).tobytes() + doc_id[docs_here].tobytes() + text_key[docs_here].tobytes() + sizes.astype(np.int64).tobytes() + start[part].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([int(chunk[owner[part[0]]])], pa.int64()), pa.array([0], pa.int32()), pa.array([payload], pa.binary())], ["chunk", "kind", "payload"])


def gather_ranges(window: int):
    """Starts of a chunk's removed windows, from all buckets, as ranges of words of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                size = int(np.frombuffer(payload, np.int64, 1)[0])
                doc_id, text_key, sizes = (np.frombuffer(payload, np.int64, size, 8 + 8 * size * i) for i in range(3))
                start = np.frombuffer(payload, np.uint32, -1, 8 + 24 * size)
                for d, k, part in zip(doc_id.tolist(), text_key.tolist(), np.split(start, np.cumsum(sizes)[:-1])):
                    found.setdefault((d, k), []).append(part)
        rows = []
        for (d, k), parts in found.items():
            start = np.unique(np.concatenate(parts)).astype(np.int64)
            breaks = np.flatnonzero(np.diff(start) > window)
            low, high = start[np.concatenate([[0], breaks + 1])], start[np.concatenate([breaks, [len(start) - 1]])] + window
            rows.append((None if d == NO_ID else d, k, np.stack([low, high], 1).tobytes()))
        for at in range(0, len(rows), 5_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 5_000]), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "text_key", "ranges"])

    return run


def repeated_ranges(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, cells: int = CELLS) -> DataFrame:
    """(doc_id, text_key, ranges): the words to remove, as pairs of 64-bit places; documents without any have no row."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = spark.sparkContext.broadcast(merged_sketch(docs, text, window, anchor, cells))
    packed = docs.mapInArrow(pack_windows(sketch, text, window, anchor, cells, partitions), PACKED).repartition(partitions, "bucket")
    rows = packed.mapInArrow(mark_later, MARKED).repartition(partitions, "chunk").mapInArrow(gather_ranges(window), RANGES)
    return rows


def keep_words(column: pa.Array, ranges: list[bytes | None]) -> Iterator[tuple[int, int, bytes]]:
    """Words, removed words and remaining text (words joined by one space) of each row."""
    words = Words(column)
    keep = np.ones(len(words.start), bool)
    for row, marks in enumerate(ranges):
        for low, high in np.frombuffer(marks, np.int64).reshape(-1, 2).tolist() if marks else ():
            keep[words.first[row] + low:words.first[row] + high] = False
    start, end = words.start[keep], words.end[keep]
    before = np.concatenate([[0], np.cumsum(end - start)])
    chars = np.arange(before[-1])
    out = np.full(before[-1] + len(start), 0x20, np.uint8)  # every word and one space after it
    out[chars + np.repeat(np.arange(len(start)), end - start)] = words.data[chars + np.repeat(start - before[:-1], end - start)]
    kept = out.tobytes()
    lengths = np.concatenate([[0], np.cumsum(end - start + 1)])
    first = np.concatenate([[0], np.cumsum(keep)])[words.first]
    for row in range(len(words.first) - 1):
        a, b = first[row], first[row + 1]
        count = int(words.first[row + 1] - words.first[row])
        yield count, count - int(b - a), kept[lengths[a]:max(lengths[a], lengths[b] - 1)]


def without_repeats(docs: DataFrame, text: str = "text", digest: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed and the remaining text (or its SHA-256) of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    # equal rows of one document give equal ranges from several chunks: they are united here
    marks = materialize(repeated_ranges(source, text, **options), "ranges").groupBy("doc_id", "text_key").agg(F.collect_set("ranges").alias("ranges"))
    column = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            ranges = [None if r is None else b"".join(r) for r in batch.column("ranges").to_pylist()]
            counts, removed, kept = zip(*keep_words(batch.column(text), ranges))
            last = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode() for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(last, pa.string())], ["doc_id", "n_words", "n_removed", column])

    known = marks.select(F.col("doc_id").alias("marked_id"), F.col("text_key").alias("marked_key"), "ranges")
    joined = source.join(known, F.col("doc_id").eqNullSafe(F.col("marked_id")) & (F.col("text_key") == F.col("marked_key")), "left")
    return joined.select("doc_id", text, "ranges").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {column} string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op2_substring_dedup": op2_substring_dedup}

SQL = {
    "op2_substring_dedup": r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM tokens WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later
), kept AS (
  SELECT t.doc_id, count(*) AS n, string_agg(t.word, ' ' ORDER BY t.p) AS body
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM tokens) t
  LEFT JOIN covered c ON c.doc_id = t.doc_id AND c.p = t.p WHERE c.p IS NULL GROUP BY t.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM tokens LEFT JOIN kept USING (doc_id)
"""
}
