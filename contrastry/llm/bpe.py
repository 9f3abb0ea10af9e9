"""Byte-level BPE by speculation: greedy longest match, pair checks, exact merging where needed.

A token sequence is the BPE encoding of a word exactly when every adjacent pair of tokens is
*compatible*: encoding the two tokens' bytes on their own gives the same two tokens back. So
new words are first cut greedily into the longest tokens; all adjacent pairs of a slice are
then checked together in numpy by undoing merges from the later token to the earlier and
asking whether the boundary would have merged sooner; only words with a failing pair go
through the merge rules. The words of a slice walk the tokens' prefix tree, and merge, side by
side as rows of arrays; words over ``ROW_BYTES`` go one by one. Results of words are kept in a
bounded dictionary per worker; a full one keeps the words of the slice at hand.

Token ids must be the order of the merge rules, as in byte-level vocabularies; loading checks
that. Tokens that merging cannot reach are left out of the greedy step.

Defined results: NULL counts as the empty text, which has no tokens; the special token's text
becomes its id; repeated rows are encoded alike; other columns pass through, a column named
``ids`` is replaced. Words of any length are encoded whole, in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from contrastry.llm.batches import slices
from contrastry.llm.inputs import table

#: Fixed value: the word pattern of byte-level BPE.
WORD = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
VOCABULARY = "byte_bpe_50k.json"
CACHED_WORDS = 200_000
NEVER = np.int64(1) << 40
#: Longest word worked on as a row of arrays, rows merged at once, and the rank of a pair without a rule there.
ROW_BYTES, ROWS, NO_RULE = 64, 8192, np.int32(1 << 30)


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: Latin-1 signs stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge rules and special tokens of one vocabulary file."""

    def __init__(self, source: str):
        data = json.loads(source)
        symbols = byte_symbols()
        ids = data["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *self.specials.values()]))
        for token, i in ids.items():
            self.tokens[i] = bytes(symbols[c] for c in token)
        for token, i in self.specials.items():
            self.tokens[i] = token.encode()
        size = len(self.tokens)
        self.left, self.right = np.arange(size), np.arange(size)
        self.pairs: dict[tuple[int, int], int] = {}
        last = -1
        for rule in data["model"]["merges"]:
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            x, y, made = ids[a], ids[b], ids[a + b]
            if made <= last:
                raise ValueError("token ids do not follow the merge rules")
            last = made
            self.left[made], self.right[made], self.pairs[x, y] = x, y, made
        keys = np.array([x << 20 | y for x, y in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(self.pairs.values()), np.int64)[order]
        self.single = np.zeros(256, np.int64)
        for i, token in enumerate(self.tokens):
            if len(token) == 1 and token not in self.specials:
                self.single[token[0]] = i
        reached = self.left == np.arange(size)
        made_of = np.flatnonzero(~reached)
        sound = np.zeros(size, bool)
        sound[made_of] = self.compatible(self.left[made_of], self.right[made_of], made_of)
        for i in made_of:  # parts have smaller ids than the whole
            reached[i] = sound[i] and reached[self.left[i]] and reached[self.right[i]]
        for i in self.specials.values():
            reached[i] = False
        self.greedy = {self.tokens[i]: int(i) for i in np.flatnonzero(reached) if self.tokens[i]}
        self.longest = [0] * 256
        for token in self.greedy:
            self.longest[token[0]] = max(self.longest[token[0]], len(token))
        self.children, self.ends = self.prefix_tree()
        alone = np.arange(65536)
        self.byte_pairs = np.minimum(self.lookup(self.single[alone >> 8], self.single[alone & 255]), NO_RULE).astype(np.int32)
        self.special_cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.specials) + ")") if self.specials else None
        self.decimals = [b"%d," % i for i in range(size)]
        self.cache: dict[str, bytes] = {}

    def prefix_tree(self) -> tuple[np.ndarray, np.ndarray]:
        """Next node by (node, byte), or -1, and the token that ends at each node, or -1.

        Nodes without children are numbered last and share the last row, which leads nowhere."""
        inner = {token[:n] for token in self.greedy for n in range(len(token))}
        number = {prefix: i for i, prefix in enumerate(sorted(inner, key=len))}
        for token in self.greedy:
            number.setdefault(token, len(number))
        children = np.full((len(inner) + 1, 256), -1, np.int32)
        ends = np.full(len(number), -1, np.int32)
        for prefix, node in number.items():
            if prefix:
                children[number[prefix[:-1]], prefix[-1]] = node
                ends[node] = self.greedy.get(prefix, -1)
        return children, ends

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that the pair merges into, or NEVER."""
        wanted = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.made[at], NEVER)

    def compatible(self, first: np.ndarray, second: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the boundary of each pair; with ``before``, none older than that token.

        Merges are undone in reverse order of age. While a side consists of its state before
        rule ``limit``, a rule for the boundary pair that is older than ``limit`` would have
        been applied first (on equal age, the left side wins)."""
        a, b = first.astype(np.int64).copy(), second.astype(np.int64).copy()
        limit = np.full(len(a), NEVER) if before is None else before.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            broken = self.lookup(x, y) < limit[live]
            good[live[broken]] = False
            x_whole, y_whole = self.left[x] == x, self.left[y] == y
            live, x, y, x_whole, y_whole = (v[~broken & ~(x_whole & y_whole)] for v in (live, x, y, x_whole, y_whole))
            undo_left = ~x_whole & ((x > y) | y_whole)
            limit[live] = np.where(undo_left, x, y + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return good

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, end, greedy, longest = [], 0, len(word), self.greedy, self.longest
        while at < end:
            stop = min(end, at + longest[word[at]])
            while (token := greedy.get(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return out

    def merged(self, word: bytes) -> list[int]:
        """The merge rules themselves, oldest first, from the left."""
        ids: list[int | None] = [int(self.single[b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.pairs[p], i, p) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            made, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= len(ids) or ids[i] is None or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = made, None, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (p := (made, ids[after[i]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p], i, p))
            if before[i] >= 0 and (p := (ids[before[i]], made)) in self.pairs:
                heapq.heappush(heap, (self.pairs[p], before[i], p))
        return [i for i in ids if i is not None]

    def proposed_rows(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words side by side: number of tokens of each, and the tokens one word after another."""
        text = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        stop = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        live, dead = np.arange(len(raw)), len(self.children) - 1
        at, end, node = np.concatenate([[0], stop[:-1]])[:len(raw)], stop, np.zeros(len(raw), np.int64)
        best, back = node.copy(), at
        owners, found = [], []
        while len(live):
            step = self.children[np.minimum(node, dead), text[at]]
            on = (step >= 0) & (at < end)
            node, at = np.where(on, step, 0), at + on
            token = self.ends[node]  # the root ends no token
            whole = token >= 0
            best, back = np.where(whole, token, best), np.where(whole, at, back)
            off = np.flatnonzero(~on)
            if len(off):
                owners.append(live[off])
                found.append(best[off])
                at[off] = back[off]
                left = on | (at < end)
                live, at, end, node, best, back = (v[left] for v in (live, at, end, node, best, back))
        if not owners:
            return np.zeros(len(raw), np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        return np.bincount(owner, minlength=len(raw)), np.concatenate(found)[np.argsort(owner, kind="stable")]

    def merged_rows(self, raw: list[bytes]) -> list[np.ndarray]:
        """The merge rules on words side by side: in each round every word merges its oldest rule's first pair."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(sizes.max()) + 1
        column = np.arange(width)
        text = np.zeros((len(raw), width), np.int64)
        inside = column < sizes[:, None]
        text[inside] = np.frombuffer(b"".join(raw), np.uint8)
        ids = np.where(inside, self.single[text], -1)
        # the last columns of both stay empty, as a merge moves what follows it one place to the left
        rank = np.full((len(raw), width), NO_RULE, np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.byte_pairs[text[:, :-1] << 8 | text[:, 1:]], NO_RULE)
        out: list[np.ndarray] = [ids[0]] * len(raw)
        live = np.arange(len(raw))
        while len(live):
            row = np.arange(len(live))
            j = rank.argmin(1)
            made = rank[row, j]
            going = made < NO_RULE
            for i in np.flatnonzero(~going).tolist():
                out[live[i]] = ids[i, :sizes[i]]
            if not going.all():
                live, sizes, ids, rank, j, made = (v[going] for v in (live, sizes, ids, rank, j, made))
                row = np.arange(len(live))
            if not len(live):
                break
            source = np.minimum(column + (column > j[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            sizes = sizes - 1
            ids[row, j] = made
            after = ids[row, np.minimum(j + 1, width - 1)]
            rank[row, j] = np.where(j + 1 < sizes, np.minimum(self.lookup(made, np.maximum(after, 0)), NO_RULE), NO_RULE)
            has = np.flatnonzero(j > 0)
            rank[has, j[has] - 1] = np.minimum(self.lookup(ids[has, j[has] - 1], made[has]), NO_RULE)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new words together and keep the results."""
        raw = [w.encode() for w in words]
        long = [i for i, w in enumerate(raw) if len(w) > ROW_BYTES]
        if long:
            short = [i for i, w in enumerate(raw) if len(w) <= ROW_BYTES]
            words, raw = [words[i] for i in short + long], [raw[i] for i in short + long]
        rows = len(raw) - len(long)
        cuts = [self.proposed(w) for w in raw[rows:]]
        sizes, flat = self.proposed_rows(raw[:rows])
        sizes = np.concatenate([sizes, np.fromiter(map(len, cuts), np.int64, len(cuts))])
        flat = np.concatenate([flat, np.fromiter((t for cut in cuts for t in cut), np.int64, int(sizes[rows:].sum()))]).astype(np.int64)
        owner = np.repeat(np.arange(len(raw)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys, where = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
        good = self.compatible(keys >> 20, keys & 0xFFFFF)[where] if len(keys) else np.zeros(0, bool)
        packed, data, ends = self.cache, flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        start = 0
        for word, end in zip(words, ends):
            packed[word] = data[start:end]
            start = end
        failing = np.unique(owner[inner[~good]])
        for i in failing[failing >= rows].tolist():
            packed[words[i]] = np.array(self.merged(raw[i]), "<u4").tobytes()
        # words of like lengths share a block of rows
        failing = failing[failing < rows]
        length = np.fromiter(map(len, raw[:rows]), np.int64, rows)[failing]
        failing = failing[np.argsort(length, kind="stable")].tolist()
        for first in range(0, len(failing), ROWS):
            block = failing[first:first + ROWS]
            for i, ids in zip(block, self.merged_rows([raw[i] for i in block])):
                packed[words[i]] = ids.astype("<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        pieces: list[list[str | int]] = []
        unknown: set[str] = set()
        for text in texts:
            parts: list[str | int] = []
            if text:
                for part in self.special_cut.split(text) if self.special_cut else [text]:
                    if part in self.specials:
                        parts.append(self.specials[part])
                    elif part:
                        parts.extend(WORD.findall(part))
            pieces.append(parts)
            unknown.update(parts)
        if len(self.cache) > CACHED_WORDS:
            self.cache = {w: self.cache[w] for w in unknown if w in self.cache}
        fixed = {i: np.array([i], "<u4").tobytes() for i in self.specials.values()}
        new = [w for w in unknown if isinstance(w, str) and w not in self.cache]
        if new:
            self.learn(new)
        look = (self.cache | fixed).__getitem__ if any(i in unknown for i in fixed) else self.cache.__getitem__
        return [np.frombuffer(b"".join(map(look, parts)), "<u4") for parts in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def in_decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return b"".join(map(self.decimals.__getitem__, ids.tolist()))[:-1]


@lru_cache(maxsize=2)
def loaded(source: str) -> Vocabulary:
    return Vocabulary(source)


def vocabulary_source(path: str | None = None) -> str:
    """The vocabulary file, a few MB whatever the corpus; by default the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as file:
        return file.read()


def as_lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(np.int32)))


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the token ids of the text."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary_source(path))
    others = [c for c in docs.columns if c.lower() != "ids"]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(source.value)
        for batch in slices(batches, text):
            rows = vocabulary.encode_all(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, as_lists(rows)], [*others, "ids"])

    return docs.select(*[f"`{c}`" for c in others]).mapInArrow(run, schema)


def decode(coded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``coded`` with ``text``, the text of the ids; NULL for NULL."""
    source = coded.sparkSession.sparkContext.broadcast(vocabulary_source(path))
    others = [c for c in coded.columns if c.lower() != "text"]
    schema = T.StructType([*[coded.schema[c] for c in others], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(source.value)
        for batch in batches:
            rows = [None if r is None else vocabulary.decode(np.array(r, np.int64)).decode("utf-8", "replace") for r in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.string())], [*others, "text"])

    return coded.select(*[f"`{c}`" for c in others]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``doc_id``, ``n_tokens``, digests of the ids and of the decoded text, and the ids if wanted."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary_source(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(source.value)
        for batch in slices(batches, text):
            rows = vocabulary.encode_all(batch.column(text).to_pylist())
            columns = [
                batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(vocabulary.in_decimals(r)).hexdigest() for r in rows]),
                pa.array([hashlib.sha256(vocabulary.decode(r).decode("utf-8", "replace").encode()).hexdigest() for r in rows]),
            ]
            yield pa.RecordBatch.from_arrays(columns + [as_lists(rows)] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
SQL: dict[str, str] = {}
