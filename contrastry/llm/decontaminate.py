"""Benchmark decontamination under word edits: CGK walks, bit sampling, exact verification.

An item leaks into a document when some stretch of the document is within a word edit distance
of ``floor(PERCENT_EDITS % of the item's words)``; case and punctuation do not count. The CGK
embedding walks over a string and repeats or advances by random bits of the word it stands on;
two strings a few edits apart fall into step again after each edit, so most places of their
walks agree. Each repetition samples a few places of its own walk over the item-sized window
and looks the sampled words up among the items' samples. Colliding (window, item) pairs are
verified exactly, by a semi-global edit distance over the stretch around the window.

``REPETITIONS`` walks with ``SAMPLED`` places each set the recall: the target is 0.9 where a
quarter of the words are edited, and more for fewer edits (measured in the tests). Windows start at
every word, in classes of item sizes. Walks over long strings drift apart for good, so an item of more
than ``PIECE`` words is cut into pieces; whatever the edits, some piece has no more than its own share
of them, and its windows stand for the item's, which is verified whole. Before walking, windows that cannot match any item are
left out by the q-gram lemma (k edits leave all but q * k of the q-grams), which loses nothing.

The benchmark is a stated query set: it is broadcast in blocks of at most ``BLOCK_ITEMS`` items,
one pass over the documents for each block. Rows are (doc_id, item_id, distance, item_words,
start_word), the best stretch for each pair.

Defined results: NULL, empty and wordless texts or items match nothing; items of fewer than
four words match only exactly; repeated rows give the same rows again once per id; documents
with a NULL id are matched under NULL; empty tables give empty results. Texts and items of any
length are read whole; a pair takes time in proportion to the item's words times twice as many, and
memory in proportion to the item's words. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.llm.batches import slices
from contrastry.llm.inputs import table
from contrastry.llm.wordhash import PUNCTUATION, Words, mix

PERCENT_EDITS = 25
REPETITIONS = 12
SAMPLED = 2
CLASS_RATIO = 1.15
BLOCK_ITEMS = 20_000
#: Words of an item that one walk covers; longer items are cut into equal pieces of at most so many.
PIECE = 64
#: Bytes of text walked over together.
SLICE = 6 << 20
#: Pairs verified at once, and the cells of each of the six arrays (8 bytes a cell) used for it.
PAIRS, CELLS = 1_000, 1 << 21
#: Bits of the table of the items' q-grams.
GRAM_BITS = 1 << 22
#: Fixed value: the word behind the end of a string.
PAD = np.uint64(0)

MATCH = "doc_id long, item_id long, distance int, item_words int, start_word long"


def edits(words: int) -> int:
    return words * PERCENT_EDITS // 100


@lru_cache(maxsize=None)
def odd_number(repetition: int, step: int) -> np.uint64:
    return mix(np.array([repetition * 1_000_003 + step + 1], np.uint64))[0] | np.uint64(1)


def walk_bits(hashes: np.ndarray, repetition: int, step: int) -> np.ndarray:
    """The random bit of each word at a step of a walk (multiply-shift); behind the end the walk stands still."""
    return (hashes * odd_number(repetition, step) >> np.uint64(63)).astype(np.int64)


def signatures(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, places: np.ndarray, repetition: int) -> np.ndarray:
    """Hash of the words at the sampled places of the walk over hashes[start:end], for each start."""
    at = start.astype(np.int64).copy()
    out = np.full(len(start), repetition + 1, np.uint64)
    chosen = set(places.tolist())
    for step in range(int(places.max()) + 1):
        here = np.where(at < end, hashes[np.minimum(at, len(hashes) - 1)], PAD)
        if step in chosen:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + here)
        at += walk_bits(here, repetition, step)
    return out


class Items:
    """One block of the benchmark, by classes of item size."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        words = Words(pa.array([t or "" for t in texts], pa.string()), lower=True, separator=PUNCTUATION)
        counts = words.counts()
        self.hashes, self.first = words.hash, words.first
        self.ids, self.counts = np.array([-1 if i is None else i for i in ids], np.int64), counts
        # pieces: (item, first word within it, words); together they are the item
        parts = -(-counts // PIECE)
        self.piece_item = np.repeat(np.arange(len(counts)), parts)
        number = np.arange(len(self.piece_item)) - np.repeat(np.cumsum(parts) - parts, parts)
        whole, cuts = counts[self.piece_item], parts[self.piece_item]
        self.offset = number * whole // np.maximum(cuts, 1)
        lengths = (number + 1) * whole // np.maximum(cuts, 1) - self.offset
        begins = words.first[self.piece_item] + self.offset
        self.classes = []
        sizes = np.unique(lengths[lengths > 0])
        while len(sizes):
            low = int(sizes[0])
            high = max(low, int(low * CLASS_RATIO))
            members = np.flatnonzero((lengths >= low) & (lengths <= high))
            most = edits(high)
            gram = 2 if low >= 8 else 1
            reach = max(1, int(2 * low * 0.8))
            rng = np.random.default_rng(low)
            tables = []
            for r in range(REPETITIONS):
                places = np.sort(rng.choice(reach, min(SAMPLED, reach), replace=False))
                own = signatures(self.hashes, begins[members], begins[members] + lengths[members], places, r)
                order = np.argsort(own, kind="stable")
                tables.append((places, own[order], members[order]))
            self.classes.append((low, most, gram, max(1, low - (gram - 1) - gram * most), tables))
            sizes = sizes[sizes > high]
        self.grams = {}
        for gram in (1, 2):
            held = np.zeros(GRAM_BITS, bool)
            for i in np.flatnonzero(counts >= gram).tolist():
                at = np.arange(self.first[i], self.first[i + 1] - gram + 1)
                held[(words.spans(at, at + gram) % np.uint64(GRAM_BITS)).astype(np.int64)] = True
            self.grams[gram] = held

    def candidates(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(window start, piece of an item) pairs that collide in some repetition."""
        total = len(words.hash)
        row_end = np.repeat(words.first[1:], words.counts())
        sums = {}
        for gram, held in self.grams.items():
            if any(c[2] == gram for c in self.classes) and total >= gram:
                hit = held[(words.grams(gram) % np.uint64(GRAM_BITS)).astype(np.int64)]
                hit &= np.arange(len(hit)) + gram <= row_end[:len(hit)]
                sums[gram] = np.concatenate([[0], np.cumsum(hit, dtype=np.int32), np.full(gram - 1, hit.sum(), np.int32)])
        starts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, _, gram, needed, tables in self.classes:
            if gram not in sums:
                continue
            at = np.arange(total)
            seen = sums[gram][np.minimum(at + low - gram + 1, total)] - sums[gram][at]
            gated = np.flatnonzero(seen >= needed)
            if not len(gated):
                continue
            for r, (places, own, members) in enumerate(tables):
                found = signatures(words.hash, gated, row_end[gated], places, r)
                a, b = np.searchsorted(own, found, "left"), np.searchsorted(own, found, "right")
                count = b - a
                if count.any():
                    starts.append(np.repeat(gated, count))
                    items.append(members[np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())])
        return np.concatenate(starts), np.concatenate(items)

    def verified(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, distance, start word) of the stretches within the allowed distance."""
        start, piece = self.candidates(words)
        if not len(start):
            return
        row, item = np.searchsorted(words.first, start, "right") - 1, self.piece_item[piece]
        size = self.counts[item]
        slack = np.maximum(1, size * PERCENT_EDITS // 100)
        block = (start - words.first[row] - self.offset[piece]) // slack  # where the whole item would begin
        keep = np.unique(np.stack([row, item, block], 1), axis=0, return_index=True)[1]
        row, item, size, slack, block = row[keep], item[keep], size[keep], slack[keep], block[keep]
        low = words.first[row] + np.maximum(0, (block - 1) * slack)
        high = np.minimum(words.first[row + 1], words.first[row] + (block + 2) * slack + size + slack)
        order = np.argsort(size, kind="stable")
        order = order[(high - low)[order] >= np.maximum(1, size - slack)[order]]  # a shorter stretch lacks too many words
        for begin, end in together((high - low)[order]):
            part = order[begin:end]
            best, begins = semi_global(words.hash, low[part], high[part], self.hashes, self.first[item[part]], size[part])
            for i in np.flatnonzero(best <= size[part] * PERCENT_EDITS // 100).tolist():
                k = part[i]
                yield int(row[k]), int(item[k]), int(best[i]), int(begins[i] - words.first[row[k]])


def together(widths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of pairs that are verified at once: at most ``PAIRS``, and rows times the widest within ``CELLS`` (a wider pair goes alone)."""
    begin = widest = 0
    for i, width in enumerate(widths.tolist()):
        if i > begin and (i - begin == PAIRS or (i - begin + 1) * max(widest, width) > CELLS):
            yield begin, i
            begin, widest = i, 0
        widest = max(widest, width)
    if len(widths):
        yield begin, len(widths)


def semi_global(text: np.ndarray, low: np.ndarray, high: np.ndarray, items: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest edit distance of each item to any stretch of its part of the text, and where that stretch begins."""
    width, rows, longest = int((high - low).max()), len(low), int(size.max())
    column = np.arange(width)
    inside = low[:, None] + column
    part = np.where(inside < high[:, None], text[np.minimum(inside, len(text) - 1)], PAD)
    # cost and begin travel together: cost * scale + begin, so that the smaller begin breaks ties;
    # a cost is at most longest + width, so both fit for any text that fits in memory
    scale = 1 << width.bit_length()
    state = np.arange(width + 1, dtype=np.int64)[None, :].repeat(rows, 0)
    slope = np.arange(width + 1, dtype=np.int64) * scale
    best = np.full(rows, np.iinfo(np.int64).max)
    for i in range(longest):
        word = items[np.minimum(first + i, len(items) - 1)]
        step = np.where(part == word[:, None], 0, scale)
        moved = state + scale  # the item's word is missing
        moved[:, 1:] = np.minimum(moved[:, 1:], state[:, :-1] + step)
        state = np.minimum.accumulate(moved - slope, axis=1) + slope  # words of the text are extra
        done = size == i + 1
        if done.any():
            best[done] = state[done].min(axis=1)
    return best // scale, low + best % scale


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """Best match of every (document, item) pair within the allowed distance."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col(item_text).alias("item"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    found = None
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block)
        # at most about BLOCK_ITEMS items at a time
        rows = own.collect()
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["item"] for r in rows]))
        part = source.mapInArrow(find_leaks(shared, text), MATCH)
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start_word", "item_words")).alias("best")).select(
        "doc_id", "item_id", "best.distance", "best.item_words", "best.start_word")


def find_leaks(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        for batch in slices(batches, text, SLICE):
            words = Words(batch.column(text), lower=True, separator=PUNCTUATION)
            rows = list(items.verified(words)) if len(items.classes) and len(words.hash) else []
            if rows:
                row, item, distance, start = (np.array(c, np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(row)), pa.array(items.ids[item]), pa.array(distance.astype(np.int32)),
                    pa.array(items.counts[item].astype(np.int32)), pa.array(start),
                ], ["doc_id", "item_id", "distance", "item_words", "start_word"])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` into which no item leaks, unchanged; NULL ids and repeated rows are judged row by row."""
    items = benchmark.select(F.col(item_text).alias("item"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    schema = docs.schema

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items([0] * len(shared.value), shared.value)
            for batch in slices(batches, text, SLICE):
                words = Words(batch.column(text), lower=True, separator=PUNCTUATION)
                clean = np.ones(batch.num_rows, bool)
                if len(known.classes) and len(words.hash):
                    clean[[row for row, *_ in known.verified(words)]] = False
                yield batch.filter(pa.array(clean))

        return run

    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast([r["item"] for r in own.collect()])  # one block of the query set
        docs = docs.mapInArrow(keep(shared), schema)
    return docs


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_benchmark_leaks": op8_benchmark_leaks}
SQL: dict[str, str] = {}
