"""Exact n-gram Jaccard join: pivots, regions, triangle windows, recursion.

Documents are compared by the sets of their word n-grams; two are linked when the Jaccard
similarity is at least the threshold, that is when their Jaccard distance, a metric, is at
most r. Distances between unrelated texts are all 1, so regions around sampled documents would
not separate anything. The pivots of the first level are therefore single n-grams: a text is
at distance below 1 from exactly those pivots that it contains, nearest in one fixed order
(n-grams that are in many documents last, then by hash), and two linked texts share one of their first n - ceil(t n) + 1 pivots (their
windows). Regions with a pivot in common are then gathered around their first document, which
is the pivot of the second level: distances to it are exact, members within r belong to its
class, and of the others only those inside the triangle window |d(x, p) - d(y, p)| <= r are
compared, each as the next pivot, until no pair can be left (``resolve``). A region too large
for a task is split by distance to its pivot into pieces whose windows are replicated
(``split_regions``), and the pieces are joined in the same way. A pivot brings two texts together
only if what follows it in both, in that order, is enough for a link (``furthest``). The order keeps
a passage that many unrelated texts quote from gathering them; it is one for all texts, whatever
n-grams are taken for frequent, so no link depends on it.

Before any region is formed, an exact filter removes documents that cannot have a partner: a
linked document has at most the fraction 1 - t of its n-grams for itself, so no more than that many
of any part of them occur in one document alone. The n-grams in the lower half of the hash range
are counted over the whole corpus in hash buckets, by packed columns whose size follows the n-grams,
whatever the number of buckets; a hash collision can only keep a document in.

Defined results: NULL and wordless texts have an empty set and no links; shorter texts have
one n-gram, all their words; equal sets are joined once and share a class; rows with a NULL
id take part, but never name a class (they get NULL where no id is in it); repeated rows
repeat their result; empty tables give empty results. Only the two named columns are read.
N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.llm.batches import slices
from contrastry.llm.components import components
from contrastry.llm.inputs import table
from contrastry.llm.wordhash import Words, mix
from contrastry.session import materialize

NGRAM = 5
PERCENT = 75
#: Bytes of n-gram sets that a task may hold for one region.
REGION_BYTES = 64 << 20
#: Documents and n-grams packed together before they are handed to the shuffle.
CHUNK_GRAMS = 2_000_000
#: Bits of the filter of candidate sets; it is broadcast, 4 MB whatever the corpus.
FILTER_BITS = 1 << 25
#: N-gram hashes below it are counted by the first filter.
HALF = np.uint64(1 << 63)
#: N-grams counted in so many documents come last in the order of pivots.
FREQUENT = 32

PACKED = "bucket int, kind int, chunk long, payload binary"
COUNTED = "chunk long, kind int, payload binary"
SETS = "doc_id long, n long, set_key long, single long"


def gram_sets(batch: pa.RecordBatch, text: str, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row."""
    words = Words(batch.column(text), lower=True)
    grams, first, out = words.grams(size), words.first, []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        else:
            out.append(words.spans(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def set_key(grams: np.ndarray) -> int:
    """64-bit key of a set; 0 for the empty set."""
    if not len(grams):
        return 0
    return int(mix(np.array([np.bitwise_xor.reduce(mix(grams + np.uint64(len(grams))))], np.uint64)).view(np.int64)[0]) or 1


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document ids, with 0 for NULL, and which are NULL."""
    column = batch.column("doc_id")
    return np.asarray(column.fill_null(0)), np.asarray(column.is_null())


def cells(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and number inside the bucket of n-grams in the lower half of the hash range."""
    return ((grams >> np.uint64(31)) * np.uint64(buckets) >> np.uint64(32)), grams.astype(np.uint32)


def pack_steps(owners: np.ndarray) -> bytes:
    """Ascending numbers from 0 on as the steps between them, one byte for each 255 of a step and one for the rest."""
    full, rest = np.divmod(np.diff(owners, prepend=0), 255)
    out = np.full(len(owners) + int(full.sum()), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = rest
    return out.tobytes()


def unpack_steps(packed: np.ndarray) -> np.ndarray:
    return np.cumsum(packed, dtype=np.int64)[packed != 255]


def pack_grams(text: str, size: int, buckets: int):
    """Map side of counting: for each chunk a directory of its documents and, for each bucket, the hashes of
    the n-grams that fall there, after the documents that they belong to. Only the lower half of the hash range counts."""
    def flush(docs: list[tuple], sets: list[np.ndarray], number: int) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([d[0] for d in docs])
        nulls = np.concatenate([d[1] for d in docs])
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        keys = np.fromiter(map(set_key, sets), np.int64, len(sets))
        place = TaskContext.get().partitionId() * 1_000_003 + number
        chunk = int(mix(np.array([np.bitwise_xor.reduce(mix(keys.view(np.uint64) + np.arange(len(keys), dtype=np.uint64))) + np.uint64(place)], np.uint64)).view(np.int64)[0])
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        lower = grams < HALF
        grams, owner = grams[lower], owner[lower]
        counted = np.bincount(owner, minlength=len(sets)).astype(np.int64)
        bucket, low = cells(grams, buckets)
        bucket = bucket.astype(np.uint16 if buckets < 65536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        low, owner = low[order], owner[order]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        payloads = [np.array([len(ids)], np.int64).tobytes() + ids.astype(np.int64).tobytes() + nulls.astype(np.uint8).tobytes() + sizes.tobytes() + keys.tobytes() + counted.tobytes()]
        for b in range(buckets):
            part = slice(edges[b], edges[b + 1])
            payloads.append(np.array([edges[b + 1] - edges[b]], np.int64).tobytes() + low[part].tobytes() + pack_steps(owner[part]))
        yield pa.RecordBatch.from_arrays([
            pa.array([abs(chunk) % buckets, *range(buckets)], pa.int32()), pa.array([0] + [1] * buckets, pa.int32()), pa.array([chunk] * (buckets + 1), pa.int64()), pa.array(payloads, pa.binary()),
        ], ["bucket", "kind", "chunk", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sets, held, number = [], [], 0, 0
        for batch in slices(batches, text):
            found = gram_sets(batch, text, size)
            docs.append(rows_of(batch))
            sets += found
            held += sum(map(len, found)) + len(found)
            if held >= CHUNK_GRAMS:
                yield from flush(docs, sets, number)
                docs, sets, held, number = [], [], 0, number + 1
        if sets:
            yield from flush(docs, sets, number)

    return run


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: for each chunk the documents of those n-grams that occur in two documents here, once for each
    (kind 1), and the n-grams that occur in many (kind 2)."""
    chunks, owners, values = [], [], []
    for batch in batches:
        for kind, bucket, chunk, payload in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "chunk", "payload"))):
            if kind == 0:
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([0], pa.int32()), pa.array([payload], pa.binary())], ["chunk", "kind", "payload"])
                continue
            size = int(np.frombuffer(payload, np.int64, 1)[0])
            chunks.append(chunk)
            values.append(np.frombuffer(payload, np.uint32, size, 8).astype(np.uint64) | np.uint64(bucket) << np.uint64(32))
            owners.append(np.frombuffer(payload, np.uint8, -1, 8 + 4 * size))
    if not chunks:
        return
    ends = np.cumsum([len(v) for v in values])
    grams = np.concatenate(values)
    del values
    order = np.argsort(grams)
    ranked = grams[order]
    twin = np.zeros(len(grams), bool)
    same = ranked[1:] == ranked[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    repeated = np.zeros(len(grams), bool)
    repeated[order] = twin
    first = np.flatnonzero(np.concatenate([[True], ~same]) if len(grams) else [])
    many = ranked[first[np.diff(first, append=len(grams)) >= FREQUENT]]
    if len(many):
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([2], pa.int32()), pa.array([many.tobytes()], pa.binary())], ["chunk", "kind", "payload"])
    for chunk, owner, end in zip(chunks, owners, ends):
        owner = unpack_steps(owner)
        here = pack_steps(owner[repeated[end - len(owner):end]])
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([1], pa.int32()), pa.array([here], pa.binary())], ["chunk", "kind", "payload"])


def add_counts(buckets: int):
    """Sum the counts of each chunk over all buckets; a missing bucket is an error, never a silent loss."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory: dict[int, bytes] = {}
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for chunk, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "payload"))):
                if kind == 0:
                    directory[chunk] = payload
                else:
                    parts.setdefault(chunk, []).append(payload)
        for chunk, payload in directory.items():
            found = parts.pop(chunk, [])
            if len(found) != buckets:
                raise RuntimeError(f"chunk {chunk} has counts of {len(found)} of {buckets} buckets")
            size = int(np.frombuffer(payload, np.int64, 1)[0])
            ids = np.frombuffer(payload, np.int64, size, 8)
            nulls = np.frombuffer(payload, np.uint8, size, 8 + 8 * size).astype(bool)
            sizes, keys, counted = np.frombuffer(payload, np.int64, 3 * size, 8 + 9 * size).reshape(3, size)
            owners = np.concatenate([unpack_steps(np.frombuffer(part, np.uint8)) for part in found])
            single = counted - np.bincount(owners, minlength=size)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(sizes), pa.array(keys), pa.array(single)], ["doc_id", "n", "set_key", "single"])

    return run


def measured_sets(docs: DataFrame, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, set_key, single) of every document, single being how many of the n-grams counted occur in it
    alone; and the cells of frequent n-grams, many in a row."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.mapInArrow(pack_grams(text, size, partitions), PACKED).repartition(partitions, "bucket")
    counted = materialize(packed.mapInArrow(count_grams, COUNTED), "counts")
    sets = counted.where("kind < 2").repartition(partitions, "chunk").mapInArrow(add_counts(partitions), SETS)
    return materialize(sets, "sets"), counted.where("kind = 2").select("payload")


def tokens(doc_id: np.ndarray, absent: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for a (document, set) pair; documents without an id share theirs."""
    return keys ^ mix(np.where(absent, -1, doc_id).astype(np.int64).view(np.uint64)).view(np.int64)


def filter_bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    mixed = mix(keys.view(np.uint64) + np.uint64(11))
    return [(mixed >> np.uint64(s)) % np.uint64(bits) for s in (0, 17, 34)]


def bloom_filter(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """Bloom filter of 64-bit keys. A fuller filter lets more through, and loses nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for batch in batches:
            for at in filter_bits(keys(batch), bits):
                held[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for row in rows.coalesce(8).mapInArrow(run, "bits binary").collect():  # eight arrays of fixed size
        total |= np.frombuffer(row["bits"], np.uint8)
    return total


def key_filter(sets: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Filter of the pairs (doc_id, set_key)."""
    return bloom_filter(sets.select("doc_id", "set_key"), lambda batch: tokens(*rows_of(batch), np.asarray(batch.column("set_key"))), bits)


def frequent_filter(cells_in: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Filter of the cells of frequent n-grams."""
    return bloom_filter(cells_in, lambda batch: np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in batch.column("payload").to_pylist())]), bits)


def in_pivot_order(grams: np.ndarray, often: np.ndarray, buckets: int) -> np.ndarray:
    """The n-grams of a set, ascending, with those in the filter ``often`` moved behind the others."""
    counted = int(np.searchsorted(grams, HALF))
    bucket, low = cells(grams[:counted], buckets)
    late = np.zeros(len(grams), bool)
    late[:counted] = np.logical_and.reduce([often[at] for at in filter_bits(bucket << np.uint64(32) | low, len(often))])
    return np.concatenate([grams[~late], grams[late]])


def candidate_sets(docs: DataFrame, text: str, size: int, wanted: np.ndarray, often: np.ndarray) -> DataFrame:
    """(set_key, n, grams) of the documents that pass the filter ``wanted``, each set once per task, its n-grams in the order of pivots."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted.tobytes(), often.tobytes()))
    bits = len(wanted) * 8
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, late = (np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in shared.value)
        done: set[int] = set()
        for batch in slices(batches, text):
            sets = gram_sets(batch, text, size)
            keys = np.fromiter(map(set_key, sets), np.int64, len(sets))
            hit = np.logical_and.reduce([kept[at] for at in filter_bits(tokens(*rows_of(batch), keys), bits)]) & (keys != 0)
            rows = [i for i in np.flatnonzero(hit).tolist() if not (keys[i] in done or done.add(keys[i]))]
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[rows]), pa.array([len(sets[i]) for i in rows], pa.int64()), pa.array([in_pivot_order(sets[i], late, buckets).tobytes() for i in rows], pa.binary()),
                ], ["set_key", "n", "grams"])

    return docs.mapInArrow(run, "set_key long, n long, grams binary")


def pivots(percent: int):
    """(pivot, set_key, n, place): the first n - ceil(t n) + 1 n-grams of each set, in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_pylist()
            parts = [np.frombuffer(grams, np.int64, n - -(-percent * n // 100) + 1) for n, grams in zip(sizes, batch.column("grams").to_pylist())]
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            if len(parts):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(parts)), pa.array(np.repeat(np.asarray(batch.column("set_key")), lengths)), pa.array(np.repeat(np.array(sizes, np.int64), lengths)),
                    pa.array(np.concatenate([np.arange(k) for k in lengths.tolist()])),
                ], ["pivot", "set_key", "n", "place"])

    return run


def furthest(size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Size of the largest set to which one of ``size`` can be linked if the n-gram at ``place`` of its order is the first they share."""
    return (100 + percent) * (size - place) // percent - size


def gathered(percent: int):
    """Task over the rows of whole pivots: memberships (region, set_key, shared), counted within the task.

    The sets of a pivot, in the order of their sizes, are cut where none before can be linked to one
    behind with this pivot as the first in common; what is left with two sets or more is gathered around
    its smallest key. Two linked sets stay together in the region of their first common pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[np.asarray(batch.column(c)) for c in ("pivot", "set_key", "n", "place")] for batch in batches]
        if not columns:
            return
        pivot, key, size, place = (np.concatenate(c) for c in zip(*columns))
        order = np.lexsort((key, size, pivot))
        pivot, key, size, place = pivot[order], key[order], size[order], place[order]
        once = np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (key[1:] != key[:-1])])  # a set from two tasks counts once
        pivot, key, size, place = pivot[once], key[once], size[once], place[once]
        another = pivot[1:] != pivot[:-1]
        base = np.concatenate([[0], np.cumsum(another)]) * (int(size.max()) * (100 + percent) // percent + 1)  # lifts each pivot over the ones before
        reach = np.maximum.accumulate(base + furthest(size, place, percent))
        cut = np.concatenate([[True], another | (reach[:-1] < (base + size)[1:])])
        start = np.flatnonzero(cut)
        length = np.diff(np.concatenate([start, [len(key)]]))
        region = np.repeat(np.minimum.reduceat(key, start), length)
        shared = np.repeat(length, length) > 1
        region, key = region[shared], key[shared]
        order = np.lexsort((key, region))
        region, key = region[order], key[order]
        if not len(key):
            return
        first = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (key[1:] != key[:-1])]))
        yield pa.RecordBatch.from_arrays([pa.array(region[first]), pa.array(key[first]), pa.array(np.diff(np.concatenate([first, [len(key)]])))], ["region", "set_key", "shared"])

    return run


def regions(sets: DataFrame, percent: int) -> DataFrame:
    """(region, set_key, shared) of all sets that share a pivot with another of fitting size."""
    partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.mapInArrow(pivots(percent), "pivot long, set_key long, n long, place long").repartition(partitions, "pivot")
    return rows.mapInArrow(gathered(percent), "region long, set_key long, shared long").groupBy("region", "set_key").agg(F.sum("shared").alias("shared"))


class Sets:
    """Sets of one region with their n-grams renumbered, so that overlaps are counted by look-up."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.ids.max()) + 1, bool)
        self.percent = percent

    def central(self) -> int:
        """The set whose n-grams the others share most."""
        shared = np.bincount(self.ids)[self.ids]
        return int(np.argmax(np.add.reduceat(shared, self.starts[:-1]) / self.sizes))

    def similarity(self, pivot: int) -> tuple[np.ndarray, np.ndarray]:
        """Which sets are linked to the pivot, and which lie within twice the radius."""
        own = self.ids[self.starts[pivot]:self.starts[pivot + 1]]
        self.mark[own] = True
        common = np.add.reduceat(self.mark[self.ids], self.starts[:-1], dtype=np.int64)
        self.mark[own] = False
        union = self.sizes + self.sizes[pivot] - common
        return 100 * common >= self.percent * union, 100 * common >= (2 * self.percent - 100) * union


def resolve(sets: list[np.ndarray], percent: int, only: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the classes of a region, every pair being compared or excluded.

    A pivot is compared with all. A set linked to a pivot is covered. If x and y are covered by
    pivots p and q and neither was a pivot, d(x, y) <= r implies d(y, p) <= 2 r; so y still has
    to become a pivot as long as a pivot of another class is that near. With ``only``, the
    pivots to use are given and all of them are used."""
    store = Sets(sets, percent)
    size = len(sets)
    label = np.arange(size)
    links: list[tuple[int, int]] = []

    def use(pivot: int) -> tuple[np.ndarray, np.ndarray]:
        linked, near = store.similarity(pivot)
        for c in np.unique(label[linked]).tolist():
            if c != label[pivot]:
                other = int(np.flatnonzero(linked & (label == c))[0])
                links.append((pivot, other))
                label[label == c] = label[pivot]
        return linked, near

    if only is not None:
        for pivot in only.tolist():
            use(pivot)
        return links
    used = np.zeros(size, bool)
    covered = np.zeros(size, bool)
    centres: list[int] = []
    near_of: list[np.ndarray] = []
    following = store.central()
    while following >= 0:
        linked, near = use(following)
        used[following] = True
        covered |= linked
        centres.append(following)
        near_of.append(near)
        left = np.flatnonzero(~used & ~covered)
        if not len(left):
            open_ = np.zeros(size, bool)
            for centre, near in zip(centres, near_of):
                open_ |= near & (label != label[centre])
            left = np.flatnonzero(open_ & ~used)
        following = int(left[0]) if len(left) else -1
    return links


def smallest_of_class(keys: list[int], links: list[tuple[int, int]]) -> list[int]:
    """For each key the smallest key that the links connect it with."""
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        if keys[a] > keys[b]:
            a, b = b, a
        parent[b] = a
    return [keys[root(i)] for i in range(len(keys))]


def linked_inside(percent: int, group: tuple[str, ...]):
    """Task over rows sorted by ``group``: links of each group. With a column ``role``, sets of role 1 are the pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, sets, roles = None, [], [], []

        def finish() -> Iterator[pa.RecordBatch]:
            if len(keys) < 2:
                return
            only = np.flatnonzero(roles) if "role" in names else None
            low = smallest_of_class(keys, resolve(sets, percent, only))
            found = [(key, root) for key, root in zip(keys, low) if key != root]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        names: list[str] = []
        for batch in batches:
            names = batch.schema.names
            role = batch.column("role").to_pylist() if "role" in names else [0] * batch.num_rows
            for *place, key, grams, part in zip(*(batch.column(c).to_pylist() for c in group), batch.column("set_key").to_pylist(), batch.column("grams").to_pylist(), role):
                if place != current:
                    yield from finish()
                    current, keys, sets, roles = place, [], [], []
                if keys and key == keys[-1]:  # the same set from several tasks
                    roles[-1] |= part
                    continue
                keys.append(key)
                sets.append(np.frombuffer(grams, np.uint64))
                roles.append(part)
        yield from finish()

    return run


def to_centre(percent: int):
    """Task over pieces of a large region, its centre first: distance of each set to the centre, in steps of a fiftieth."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for region, piece, key, grams in zip(*(batch.column(c).to_pylist() for c in ("region", "piece", "set_key", "grams"))):
                own = np.frombuffer(grams, np.uint64)
                if (region, piece) != current:
                    if key != region:
                        raise RuntimeError("a piece of a region came without its centre")
                    current, centre = (region, piece), own
                common = len(np.intersect1d(centre, own, assume_unique=True))
                union = len(centre) + len(own) - common
                out.append((region, key, 100 * common >= percent * union, int(50 * (union - common) / union)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], ["region", "set_key", "linked", "step"])

    return run


def split_regions(members: DataFrame, sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links inside regions larger than ``limit`` bytes.

    First all members are compared with the region's centre, piece by piece. Members linked to
    it are of its class. The others become pivots, in blocks of equal distance to the centre;
    each block is joined with the members inside its triangle window, piece by piece."""
    spark = sets.sparkSession
    sized = members.join(sets.select("set_key", "n").distinct(), "set_key")
    half = max(1, limit // 2)
    wide = sized.groupBy("region").agg((F.floor(F.sum("n") * 8 / half) + 1).cast("int").alias("pieces"))
    rows = sized.join(wide, "region").withColumn("piece", F.pmod(F.xxhash64("set_key"), F.col("pieces")).cast("int"))
    centres = wide.select("region", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("region").alias("set_key"))
    placed = rows.select("region", "piece", "set_key").union(centres).distinct().join(sets.dropDuplicates(["set_key"]), "set_key")
    placed = placed.withColumn("other", F.col("set_key") != F.col("region")).repartition("region", "piece").sortWithinPartitions("region", "piece", "other", "set_key")
    near = materialize(placed.mapInArrow(to_centre(percent), "region long, set_key long, linked boolean, step int"), "to-centre").distinct()
    links = near.where("linked and region <> set_key").select(F.col("region").alias("a"), F.col("set_key").alias("b"))
    located = near.join(rows.select("region", "set_key", "n", "pieces", "piece").distinct(), ["region", "set_key"])
    blocks = located.where("not linked").groupBy("region", "step").agg((F.floor(F.sum("n") * 8 / half) + 1).cast("int").alias("parts"))
    centre_block = located.where("not linked").join(blocks, ["region", "step"]).withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"))
    width = -(-(100 - percent) // 2) + 1  # the radius in steps, and one for rounding
    pivots_in = centre_block.select("region", F.col("step").alias("block"), "part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "set_key", F.lit(1).alias("role"))
    windows = blocks.select("region", F.col("step").alias("block"), "parts", F.explode(F.sequence(F.col("step") - width, F.col("step") + width)).alias("step"))
    members_in = located.join(windows, ["region", "step"]).select(
        "region", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "piece", "set_key", F.lit(0).alias("role"))
    joined = pivots_in.unionByName(members_in).join(sets.dropDuplicates(["set_key"]), "set_key")
    joined = joined.repartition("region", "block", "part", "piece").sortWithinPartitions("region", "block", "part", "piece", "set_key")
    return links.union(joined.mapInArrow(linked_inside(percent, ("region", "block", "part", "piece")), "a long, b long"))


def joined_regions(members: DataFrame, sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """Edges (a, b) from each set to the smallest key of its class inside each region."""
    partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weights = members.join(sets.select("set_key", "n").distinct(), "set_key").groupBy("region").agg((F.sum("n") * 8).alias("bytes"))
    sizes = materialize(weights, "region-sizes")
    small = members.join(sizes.where(F.col("bytes") <= limit).select("region"), "region")
    placed = small.join(sets, "set_key").repartition(partitions, "region").sortWithinPartitions("region", "set_key")
    links = placed.mapInArrow(linked_inside(percent, ("region",)), "a long, b long")
    large = sizes.where(F.col("bytes") > limit)
    if large.isEmpty():
        return links
    return links.union(split_regions(materialize(members.join(large.select("region"), "region"), "large-regions"), sets, limit, percent))


def region_links(members: DataFrame, sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """Edges (a, b) between set keys that connect exactly the classes of linked sets.

    Each set first goes to its home, the region with which it shares most pivots. Regions whose
    members then all have one label need no second look; the others are joined in full."""
    home = members.groupBy("set_key").agg(F.max(F.struct("shared", "region")).alias("best")).select(F.col("best.region").alias("region"), "set_key")
    first = materialize(joined_regions(home, sets, percent, limit), "home-links").distinct()
    label = first.groupBy("a").agg(F.min("b").alias("label"))
    labelled = members.join(label, members["set_key"] == label["a"], "left").select("region", "set_key", F.coalesce("label", "set_key").alias("label"))
    mixed = labelled.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("region")
    rest = materialize(members.join(mixed, "region").select("region", "set_key"), "mixed-regions")
    return first.union(joined_regions(rest, sets, percent, limit))


def jaccard_classes(docs: DataFrame, text: str = "text", size: int = NGRAM, percent: int = PERCENT, limit: int = REGION_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text))
    measured, frequent = measured_sets(source, text, size)
    # a key stands for the smallest id that has it; only that document is a candidate
    named = measured.where(F.col("n") > 0).groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min("single").alias("single"))
    possible = named.where(100 * F.col("single") <= (100 - percent) * F.col("n")).select(F.col("first_id").alias("doc_id"), "set_key")
    sets = materialize(candidate_sets(source, text, size, key_filter(possible), frequent_filter(frequent)), "candidates")
    members = materialize(regions(sets, percent), "regions")
    links = region_links(members, sets, percent, limit)
    # classes of keys, then of documents
    classes = components(links)
    ids = classes.join(named, classes["node"] == named["set_key"]).groupBy("component").agg(F.min("first_id").alias("class_id"))
    linked = classes.join(ids, "component").select(F.col("node").alias("set_key"), "class_id")
    alone = named.where("copies > 1").join(linked, "set_key", "left_anti").select("set_key", F.col("first_id").alias("class_id"))
    shared = linked.union(alone)
    return measured.join(shared, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}

SQL = {
    "op1_ngram_jaccard": r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM tokens WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) USING (doc_id)
"""
}
