"""Periodic runs of words: maximal pairs of an LCP-interval tree.

A run is a stretch of words with smallest period q, ``LEAST_EXPONENT`` periods long at least,
that no neighbouring word extends. Two suffixes of a text that are preceded by different words
and share exactly ``lcp`` words are a maximal pair; where their distance p is at most ``lcp / 3``
the pair spans a run of period p and p + lcp words, and each run has exactly one such pair with
its smallest period, between neighbouring occurrences. So nothing is extended: pairs are read off
the tree of LCP intervals, bottom up. Every interval holds the places of its suffixes, marked by
the class of the word to their left; when a child joins, each of its places meets its nearest
neighbours of the other side, and a pair counts where the classes differ.

Ranks of suffixes come from prefix doubling over a whole slice of texts at once, where suffixes
of different texts differ from the start; the ranks of all lengths 1, 2, 4… are kept (4 bytes
for each word and length) and give the exact lcp of any two suffixes. Suffixes without a near
occurrence of their first words cannot stand in a pair and stay out of the tree, which loses
nothing. Words are told apart by 64-bit hashes; a reported run is verified on the words.

Spark partitions the documents; each text is worked on whole, in one task.

Defined results: NULL, empty and wordless texts have no runs and collapse to an empty text;
documents with a NULL id and repeated rows are judged row by row; an empty table gives an empty
result. Columns beyond the id and the text are dropped, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.llm.batches import slices
from contrastry.llm.inputs import let, table, words
from contrastry.llm.wordhash import Words

LEAST_EXPONENT = 4
LEAST_LENGTH = 6

RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


# ------------------------------------------------------------------ suffixes
class Suffixes:
    """Ranks of the suffixes of many texts by their first 1, 2, 4… words, within each text."""

    def __init__(self, codes: np.ndarray, text: np.ndarray):
        """``codes``: one number for each word, equal for equal words of one text only; ``text``: ascending."""
        size = len(codes)
        order = np.lexsort((codes, text))
        rank = np.empty(size, np.int64)
        rank[order] = first_of_equal(codes[order], text[order])
        self.levels = [rank.astype(np.int32)]
        ends = np.searchsorted(text, text, "right")
        open_ = order[in_group(rank[order])]
        reach = 1
        while len(open_):
            later = open_ + reach
            behind = np.where(later < ends[open_], rank[np.minimum(later, size - 1)], -1)
            key = rank[open_] * (size + 1) + behind + 1
            order = np.argsort(key, kind="stable")
            open_, key = open_[order], key[order]
            own, split = rank[open_], first_of_equal(key)
            rank[open_] = own + split - first_of_equal(own)  # a group is divided within its own places
            self.levels.append(rank.astype(np.int32))
            open_ = open_[in_group(split)]
            reach *= 2
        self.ends = ends

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that the suffixes a and b have in common."""
        a, b = a.copy(), b.copy()
        total = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks = self.levels[level]
            inside = (a < self.ends[a - total]) & (b < self.ends[b - total])
            same = inside & (ranks[np.minimum(a, len(ranks) - 1)] == ranks[np.minimum(b, len(ranks) - 1)])
            step = np.where(same, 1 << level, 0)
            a, b, total = a + step, b + step, total + step
        return total


def first_of_equal(*sorted_keys: np.ndarray) -> np.ndarray:
    """For each place the first place of its group of equal keys."""
    size = len(sorted_keys[0])
    new = np.zeros(size, bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(size), 0))


def in_group(first: np.ndarray) -> np.ndarray:
    """Whether a place's group (by first place) has several members."""
    same = np.zeros(len(first), bool)
    same[1:] = first[1:] == first[:-1]
    same[:-1] |= same[1:]
    return same


def near_repeats(suffixes: Suffixes, text: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that may stand in a run's pair, in tree order, and what each shares with the next.

    A pair shares ``lcp`` >= (exponent - 1) * p and >= least - p words at distance p. So each of
    its suffixes shares that many with a neighbour in order, and meets the first of them again
    within that distance.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    shortest = min(max((exponent - 1) * p, least - p) for p in range(1, least + 2))
    ranks = suffixes.levels[min(shortest.bit_length(), len(suffixes.levels)) - 1]
    by_place = np.argsort(ranks, kind="stable")
    by_place = by_place[in_group(ranks[by_place])]
    if not len(by_place):
        return none
    gap = np.diff(by_place)
    gap[np.diff(ranks[by_place]) != 0] = len(ranks)
    nearest = np.full(len(ranks), len(ranks))
    nearest[by_place[1:]] = gap
    nearest[by_place[:-1]] = np.minimum(nearest[by_place[:-1]], gap)
    places = np.sort(by_place)
    order = places[np.argsort(suffixes.levels[-1][places], kind="stable")]
    lcp = np.append(suffixes.shared(order[:-1], order[1:]), 0)
    lcp[:-1][text[order[:-1]] != text[order[1:]]] = 0
    longest = np.maximum(lcp, np.append(0, lcp[:-1]))
    near = nearest[order]
    kept = np.flatnonzero((near * (exponent - 1) <= longest) & (longest > 0))
    if not len(kept):
        return none
    # between two suffixes that stay, the smallest value of all between them holds
    return order[kept], np.minimum.reduceat(lcp, kept)


# ------------------------------------------------------------------ tree
class Places:
    """Ascending places in blocks, so that one more costs little however many there are."""

    BLOCK = 512

    def __init__(self, place: int):
        self.blocks, self.last, self.size = [[place]], [place], 1

    def neighbours(self, place: int) -> tuple[int, int]:
        """The nearest place below and above, -1 where there is none."""
        b = bisect_left(self.last, place)
        if b == len(self.last):
            return self.last[-1], -1
        block = self.blocks[b]
        i = bisect_left(block, place)
        return (block[i - 1] if i else self.last[b - 1] if b else -1), block[i]

    def add(self, place: int) -> None:
        b = min(bisect_left(self.last, place), len(self.last) - 1)
        block = self.blocks[b]
        insort(block, place)
        self.last[b] = block[-1]
        self.size += 1
        if len(block) > 2 * self.BLOCK:
            self.blocks[b:b + 1] = [block[:self.BLOCK], block[self.BLOCK:]]
            self.last[b:b + 1] = [block[self.BLOCK - 1], block[-1]]

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def maximal_pairs(order: list[int], lcp: list[int], left: np.ndarray, exponent: int, least: int) -> dict[tuple[int, int], int]:
    """Smallest distance of the maximal pairs that are long enough for it, by the stretch they span."""
    found: dict[tuple[int, int], int] = {}
    times = exponent - 1

    def join(a: Places, b: Places, shared: int) -> Places:
        small, large = (a, b) if a.size < b.size else (b, a)
        for place in small:
            below, above = large.neighbours(place)
            for i, j in ((below, place), (place, above)):
                if i >= 0 and j >= 0:
                    distance = j - i
                    if distance * times <= shared and distance + shared >= least and left[i] != left[j]:
                        span = i, j + shared
                        if distance < found.get(span, distance + 1):
                            found[span] = distance
        for place in small:
            large.add(place)
        return large

    stack: list[tuple[int, Places]] = []  # (words that its suffixes share, places) of the open intervals
    for place, shared in zip(order, lcp):
        held = Places(place)
        while stack and stack[-1][0] > shared:
            depth, earlier = stack.pop()
            held = join(earlier, held, depth)
        if shared == 0:
            stack.clear()
        elif stack and stack[-1][0] == shared:
            stack[-1] = shared, join(stack[-1][1], held, shared)
        else:
            stack.append((shared, held))
    return found


def find_runs(codes: np.ndarray, text: np.ndarray, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> np.ndarray:
    """(start, length, period) of all runs, by start and period; places count over all texts."""
    if not len(codes):
        return np.zeros((0, 3), np.int64)
    suffixes = Suffixes(codes, text)
    order, lcp = near_repeats(suffixes, text, exponent, least)
    left = np.full(len(codes), -1, np.int64)
    same = text[1:] == text[:-1]
    left[1:][same] = suffixes.levels[0][:-1][same]
    # a text's first word has a class of its own, as nothing stands before it
    pairs = maximal_pairs(order.tolist(), lcp.tolist(), left, exponent, least)
    rows = np.array([(i, j - i, p) for (i, j), p in pairs.items()], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def dropped(runs: np.ndarray, size: int) -> np.ndarray:
    """Whether a word stands in some run behind the run's first period."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


# ------------------------------------------------------------------ documents
def periodic_runs(docs: DataFrame, text: str = "text", *, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> DataFrame:
    """All runs of every text, and the text without the repetitions, its words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            column = batch.column(text).fill_null("")
            found = Words(column)
            texts = np.repeat(np.arange(batch.num_rows), found.counts())
            runs = find_runs(found.hash, texts, exponent, least)
            gone = dropped(runs, len(texts))
            data, own = [], np.searchsorted(runs[:, 0], found.first)
            for row, body in enumerate(column.cast(pa.binary()).to_pylist()):
                said = body.split()  # at the ASCII separators, like Words
                mine = runs[own[row]:own[row + 1]] - [found.first[row], 0, 0]
                for start, length, period in mine.tolist():
                    if said[start:start + length - period] != said[start + period:start + length]:
                        raise ValueError("two words share a hash")
                if len(mine):
                    said = [word for word, out in zip(said, gone[found.first[row]:found.first[row + 1]].tolist()) if not out]
                data.append((mine, b" ".join(said)))
            flat = np.concatenate([mine for mine, _ in data])
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.append(own[:-1], len(flat)), pa.int32()), parts),
                pa.array([said for _, said in data], pa.binary()).cast(pa.string()),
            ], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, RUNS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents of the contract: one in ten, by its id, repeats a stretch of itself to the end."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(hashed / 10)

    def repeated(said):
        n = F.size(said)
        start = F.pmod(g, n).cast("int")
        period = (1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(said, F.when(i < start, i).otherwise(start + F.pmod(i - start, period)))), " ")

    planted = let(words(F.col("text")), lambda said: F.when(F.size(said) > 0, repeated(said)))
    return docs.select("doc_id", F.coalesce(F.when(hashed % 10 == 0, planted), F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # the greatest exponent exactly: a fraction is compared by cross multiplication
    better = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    strongest = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda best, run: F.when(better(run, best) > 0, run).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", strongest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
SQL: dict[str, str] = {}
