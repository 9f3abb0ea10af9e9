"""Toxicity by a bidirectional gated recurrent network over characters and words.

A word's input is what a character network (both directions, attention pooling) makes of its
letters, beside a learned vector of the word; a second network of the same kind reads windows of
``WINDOW`` words and pools them by attention into one logit. All windows of a text are scored,
each overlapping the next by half, and the strongest one speaks for the text. Words longer than
``PIECE`` characters are read as overlapping pieces, so nothing of a text is left out.

Training runs in one task on a bounded sample: at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled
rows (chosen by a hash of their id), and of each at most ``WINDOWS`` evenly spaced windows. First
the character network and the words' vectors learn which words make a text toxic; then the word
network learns on the strongest windows of each text and some others of clean texts, found anew
in each round. A fifth of the rows is kept aside to calibrate the score, so that
0.7 means seven in ten. Labels, languages, sources and ids are never inputs of a score. The model
is a few hundred KB whatever the corpus.

Defined results: a NULL, empty or wordless text gets the smoothed share of label 1 among training
rows without words; rows are scored one by one, repeated rows alike, NULL ids too (not held out);
without both labels to learn from every score is the smoothed share of label 1. Labels that are
NULL, other than 0 and 1, or contradict one another are not learned from. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrastry.llm.batches import slices
from contrastry.llm.inputs import table
from contrastry.llm.recurrent import Adam, Encoder, Weights, sigmoid
from contrastry.llm.wordhash import BYTE_BASE, mix, polynomial, ranges

TOXIC_ROWS, CLEAN_ROWS = 1_500, 3_000
WINDOW, PIECE = 48, 16
WINDOWS = 64
THRESHOLD = 0.7
#: Sizes of the network; a word has a vector of its own if it stands in so many sampled texts.
LETTERS, LETTER_VECTOR, WORD_VECTOR, CHARACTER_STATE, WORD_STATE, COMMON = 256, 8, 6, 10, 10, 5
ROUNDS, WORD_TURNS, BATCH = 2, 3, 128
#: Updates of each round and turn at least, in whole epochs.
UPDATES = 400
#: A word's chance to be a toxic one before anything is known, chance of a toxic word to stray into a clean text, and words of no
#: suspicion that each turn compares with.
FIRST_PRIOR, STRAY, OTHER_WORDS = 0.01, 0.02, 40_000
#: Windows scored together.
CHUNK = 2_048

CHARACTERS = Encoder("letters", LETTER_VECTOR, CHARACTER_STATE)
WORDS = Encoder("window", 2 * CHARACTER_STATE + WORD_VECTOR, WORD_STATE)


# ------------------------------------------------------------------ texts as tokens and windows
class Tokens:
    """Lower-cased words of texts (long ones in overlapping pieces), as numbers of distinct tokens."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        letters = np.frombuffer("\n".join(lowered).encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0, *(len(t) + 1 for t in lowered[:-1])]) if lowered else np.zeros(0, np.int64)
        said = np.concatenate([[False], WORDLIKE[np.minimum(letters, 128)], [False]])
        edge = np.flatnonzero(said[1:] != said[:-1])
        begin, size = edge[::2], edge[1::2] - edge[::2]
        pieces = 1 + np.maximum(0, -(-(size - PIECE) // (PIECE // 2)))
        word = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = begin[word] + np.minimum(nth * (PIECE // 2), np.maximum(size[word] - PIECE, 0))
        size = np.minimum(size[word], PIECE)
        sums = ranges(mix(letters.astype(np.uint64) + np.uint64(1)), BYTE_BASE)
        hashes = mix(polynomial(sums, BYTE_BASE, begin, begin + size))
        self.hash, where, self.token = np.unique(hashes, return_index=True, return_inverse=True)
        self.begin, self.size, self.letters = begin[where], size[where], letters
        self.first = np.append(np.searchsorted(begin, starts), len(begin))

    def spelled(self, size: int, tokens: np.ndarray) -> np.ndarray:
        """Letters (step, token) of tokens of the same size."""
        found = self.letters[self.begin[tokens] + np.arange(size)[:, None]].astype(np.int64)
        return np.where(found < 128, found, 128 + found % 128)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and size of each window; short texts are one window, wordless ones none."""
        count = np.diff(self.first)
        number = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // (WINDOW // 2))), 0)
        text = np.repeat(np.arange(len(count)), number)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
        size = np.minimum(count[text], WINDOW)
        return text, self.first[text] + np.minimum(nth * (WINDOW // 2), count[text] - size), size


#: Whether a character belongs to a word: letters and digits of ASCII, and all beyond it.
WORDLIKE = np.array([chr(c).isalnum() for c in range(128)] + [True])


# ------------------------------------------------------------------ network
def fresh_weights(common: int, rng: np.random.Generator) -> Weights:
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "letter_vectors": rng.normal(0, 0.5, (LETTERS, LETTER_VECTOR)).astype(np.float32), "word_vectors": small(common + 1, WORD_VECTOR),
        **CHARACTERS.fresh(rng), **WORDS.fresh(rng), "word_out": small(WORDS.inputs), "word_bias": np.zeros(1, np.float32),
        "out": small(2 * WORD_STATE), "bias": np.zeros(1, np.float32),
    }


def common_numbers(common: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of a token's own vector; 0 for all others."""
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return np.where(common[at] == hashes, at + 1, 0) if len(common) else np.zeros(len(hashes), np.int64)


def by_size(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(size, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if len(group):
            yield int(size[group[0]]), group


def token_inputs(w: Weights, tokens: Tokens, common: np.ndarray, chosen: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Input vectors of the chosen tokens: pooled character states and the word's own vector."""
    out = np.empty((len(chosen), WORDS.inputs), np.float32)
    out[:, 2 * CHARACTER_STATE:] = w["word_vectors"][common_numbers(common, tokens.hash[chosen])]
    gates = CHARACTERS.projected(w, w["letter_vectors"])
    for size, group in by_size(tokens.size[chosen]):
        for at in range(0, len(group), CHUNK):
            part = group[at:at + CHUNK]
            spelled, held = tokens.spelled(size, chosen[part]), None if keep is None else []
            out[part, :2 * CHARACTER_STATE] = CHARACTERS.forward(w, gates, spelled, held)
            if keep is not None:
                keep.append((part, spelled, held))
    return out


def token_gradients(w: Weights, tokens: Tokens, common: np.ndarray, chosen: np.ndarray, keep: list, d_inputs: np.ndarray, grad: Weights) -> None:
    np.add.at(grad["word_vectors"], common_numbers(common, tokens.hash[chosen]), d_inputs[:, 2 * CHARACTER_STATE:])
    gates = CHARACTERS.projected(w, w["letter_vectors"])
    for part, spelled, held in keep:
        d_gates = CHARACTERS.backward(w, gates, spelled, held, np.ascontiguousarray(d_inputs[part, :2 * CHARACTER_STATE]), grad)
        grad["letter_vectors"] += CHARACTERS.unprojected(w, w["letter_vectors"], d_gates, grad)


def window_logits(w: Weights, tokens: Tokens, inputs: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    gates = WORDS.projected(w, inputs)
    out = np.empty(len(start), np.float32)
    for length, group in by_size(size):
        for at in range(0, len(group), CHUNK):
            part = group[at:at + CHUNK]
            pooled = WORDS.forward(w, gates, tokens.token[start[part] + np.arange(length)[:, None]])
            out[part] = pooled @ w["out"] + w["bias"][0]
    return out


# ------------------------------------------------------------------ training
def trained(texts: list[str | None], labels: list[int], seed: int = 11) -> dict[str, np.ndarray]:
    """Weights, common words and calibration learned from labelled texts."""
    rng = np.random.default_rng(seed)
    label = np.array(labels, np.float32)
    tokens = Tokens(texts)
    count = np.diff(tokens.first)
    share = (label.sum() + 1) / (len(label) + 2)
    empty = float((label[count == 0].sum() + share) / ((count == 0).sum() + 1))
    usable = count > 0
    if len(np.unique(label[usable])) < 2:
        return {"share": np.array([share]), "empty": np.array([empty])}
    aside = np.zeros(len(label), bool)  # rows for the calibration, of both labels
    for value in (0, 1):
        rows = np.flatnonzero(usable & (label == value))
        aside[rng.permutation(rows)[:len(rows) // 5]] = True
    learn = usable & ~aside

    owner = np.repeat(np.arange(len(count)), count)
    pairs = np.unique(owner * len(tokens.hash) + tokens.token)
    owner, token = pairs // len(tokens.hash), pairs % len(tokens.hash)
    mine = learn[owner]
    said = [np.bincount(token[mine & (label[owner] == value)], minlength=len(tokens.hash)).astype(np.float32) for value in (0, 1)]
    common = tokens.hash[said[0] + said[1] >= COMMON]
    w = fresh_weights(len(common), rng)
    balance = np.array([0.5 / max(1, (learn & (label == 0)).sum()), 0.5 / max(1, (learn & (label == 1)).sum())]) * learn.sum()

    words_alone(w, tokens, common, said, float(label[learn].mean()), rng)
    text, start, size = tokens.windows()
    spread = np.ones(len(text), bool)  # at most WINDOWS of each text
    number = np.bincount(text, minlength=len(count))
    nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    many = number[text] > WINDOWS
    spread[many] = (nth[many] * WINDOWS // number[text[many]]) != ((nth[many] - 1) * WINDOWS // number[text[many]])
    text, start, size = text[spread], start[spread], size[spread]

    inputs = token_inputs(w, tokens, common, np.arange(len(tokens.hash)))  # fixed from here on
    adam = Adam({k: v for k, v in w.items() if k in ("out", "bias") or k.startswith(WORDS.name + "_")}, 0.005)
    for round_ in range(ROUNDS):
        logit = window_logits(w, tokens, inputs, start, size) if round_ else first_logits(w, tokens, inputs, start, size)
        order = np.lexsort((-logit, text))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        strong = place < 2
        others = (label[text] == 0) & (rng.random(len(text)) < 4 / number[text])
        chosen = np.flatnonzero((strong & ((label[text] == 0) | (place == 0) | (logit > 0)) | others) & learn[text])
        weight = np.where(label[text[chosen]] == 1, balance[1], balance[0])
        per_text = np.bincount(text[chosen], minlength=len(count))[text[chosen]]
        weight = weight / np.where(label[text[chosen]] == 1, per_text, np.sqrt(per_text))
        epochs = epochs_for(size[chosen], BATCH)
        for epoch in range(epochs):
            adam.rate = 0.005 * (1 - (round_ + epoch / epochs) / ROUNDS) + 0.0005
            together(w, tokens, inputs, start[chosen], size[chosen], label[text[chosen]], weight.astype(np.float32), adam, rng)
    logit = np.full(len(count), -np.inf)
    np.maximum.at(logit, text, window_logits(w, tokens, inputs, start, size))
    judged = aside if len(np.unique(label[aside])) == 2 else usable
    scale, shift = calibrated(logit[judged], label[judged])
    return {**w, "common": common, "scale": np.array([scale]), "shift": np.array([shift]), "share": np.array([share]), "empty": np.array([empty])}


def words_alone(w: Weights, tokens: Tokens, common: np.ndarray, said: list[np.ndarray], share: float, rng: np.random.Generator) -> None:
    """Which words make a text toxic, by expectation and maximisation: trains what becomes the input of the word network.

    A word of ``k`` toxic and ``n`` clean texts is toxic with odds prior / (share ** k) * STRAY ** n: toxic words
    stand in toxic texts only, but for a few, others in any. The prior is small at first, and then what the
    network makes of the word's letters, so that words alike lend each other evidence.
    """
    prior = np.full(len(tokens.hash), FIRST_PRIOR, np.float32)
    evidence = said[1] * -np.log(share) + said[0] * np.log(STRAY)
    seen = np.flatnonzero(said[0] + said[1] > 0)
    adam = Adam({k: w[k] for k in w if k.startswith(("letter", "word_"))}, 0.01)
    for turn in range(WORD_TURNS):
        target = sigmoid(np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30))
        likely = seen[target[seen] > 0.05]
        rest = rng.permutation(seen[target[seen] <= 0.05])[:OTHER_WORDS]
        rows = np.concatenate([likely, rest])
        weight = np.where(target > 0.05, np.sqrt(said[0] + said[1]), 1).astype(np.float32)
        weight[likely] *= max(1.0, 0.3 * weight[rest].sum() / max(1.0, float((weight[likely] * target[likely]).sum())))
        epochs = epochs_for(tokens.size[rows], 2 * BATCH)
        for epoch in range(epochs):
            adam.rate = 0.01 * (1 - 0.9 * (turn + epoch / epochs) / WORD_TURNS)
            for part in batches_of_one_size(tokens.size[rows], 2 * BATCH, rng):
                chosen, keep = rows[part], []
                inputs = token_inputs(w, tokens, common, chosen, keep)
                p = sigmoid(inputs @ w["word_out"] + w["word_bias"][0])
                d = ((p - target[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
                grad = {k: np.zeros_like(w[k]) for k in adam.mean}
                grad["word_out"] += d @ inputs
                grad["word_bias"] += d.sum()
                token_gradients(w, tokens, common, chosen, keep, d[:, None] * w["word_out"], grad)
                adam.update(w, grad)
        prior = np.clip(sigmoid(token_inputs(w, tokens, common, np.arange(len(tokens.hash))) @ w["word_out"] + w["word_bias"][0]) * 0.5, 1e-4, 0.5)


def first_logits(w: Weights, tokens: Tokens, inputs: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strongest word of each window, before the word network has learned anything."""
    alone = inputs @ w["word_out"] + w["word_bias"][0]
    at = alone[tokens.token]
    return np.array([at[s:s + n].max() for s, n in zip(start.tolist(), size.tolist())], np.float32)


def epochs_for(size: np.ndarray, most: int) -> int:
    """Passes over the rows that make ``UPDATES`` updates, two at least."""
    batches = sum(-(-len(group) // most) for _, group in by_size(size))
    return max(2, -(-UPDATES // max(1, batches)))


def batches_of_one_size(size: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """All rows in batches, in random order."""
    batches = [part for _, group in by_size(size) for part in np.array_split(rng.permutation(group), -(-len(group) // most))]
    return [batches[k] for k in rng.permutation(len(batches)).tolist()]


def together(w: Weights, tokens: Tokens, inputs: np.ndarray, start: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray, adam: Adam, rng: np.random.Generator) -> None:
    """One epoch of the word network over windows."""
    for part in batches_of_one_size(size, BATCH, rng):
        words = tokens.token[start[part] + np.arange(size[part[0]])[:, None]]
        chosen, index = np.unique(words, return_inverse=True)
        index, x, keep = index.reshape(words.shape), inputs[chosen], []
        gates = WORDS.projected(w, x)
        pooled = WORDS.forward(w, gates, index, keep)
        d = ((sigmoid(pooled @ w["out"] + w["bias"][0]) - label[part]) * weight[part] / BATCH).astype(np.float32)
        grad = {k: np.zeros_like(w[k]) for k in adam.mean}
        grad["out"] += d @ pooled
        grad["bias"] += d.sum()
        WORDS.unprojected(w, x, WORDS.backward(w, gates, index, keep, d[:, None] * w["out"], grad), grad)
        adam.update(w, grad)


def calibrated(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit of the label, a little regularised, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * logit + b)
        v = p * (1 - p)
        g = np.array([((p - label) * logit).sum() + 0.1 * (a - 1), (p - label).sum() + 0.01 * b])
        h = np.array([[(v * logit * logit).sum() + 0.1, (v * logit).sum()], [(v * logit).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.05), b


# ------------------------------------------------------------------ scoring on Spark
def scores(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """Score of each text, from all its windows."""
    tokens = Tokens(texts)
    wordless = np.diff(tokens.first) == 0
    if "out" not in model:
        return np.where(wordless, model["empty"][0], model["share"][0])
    text, start, size = tokens.windows()
    logit = np.full(len(texts), -np.inf)
    inputs = token_inputs(model, tokens, model["common"], np.arange(len(tokens.hash)))
    np.maximum.at(logit, text, window_logits(model, tokens, inputs, start, size))
    return np.where(wordless, model["empty"][0], sigmoid(np.clip(model["scale"][0] * np.where(wordless, 0, logit) + model["shift"][0], -30, 30)))


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> DataFrame:
    """The bounded sample: (doc_id, text, label), one row for each id."""
    agreed = (
        labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_high")).where(F.col("label") == F.col("_high")).select(F.col("doc_id").alias("_id"), "label")
    )
    chosen = [agreed.where(F.col("label") == value).orderBy(F.xxhash64("_id"), "_id").limit(rows) for value, rows in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    # at most TOXIC_ROWS + CLEAN_ROWS ids and labels; of repeated ids one fixed text
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))
    return docs.select(F.col("doc_id"), F.col(text).alias("text")).join(sample, F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> dict[str, np.ndarray]:
    """The model, trained in one task on the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda r: r["doc_id"])
        held = io.BytesIO()
        np.savez_compressed(held, **trained([r["text"] for r in rows], [r["label"] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], ["model"])

    made = training_rows(docs, labels, text, label).coalesce(1).mapInArrow(run, "model binary").collect()
    with np.load(io.BytesIO(made[0]["model"] if made else empty_model())) as found:
        return {k: found[k] for k in found.files}


def empty_model() -> bytes:
    held = io.BytesIO()
    np.savez_compressed(held, **trained([], []))
    return held.getvalue()


def scored(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(shared.value, batch.column(text).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op11_toxicity": op11_toxicity}
SQL: dict[str, str] = {}
