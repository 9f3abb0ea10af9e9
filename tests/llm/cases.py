"""Awkward tables that every text operator must survive, and small random corpora."""

import random

CLASHING = "ids string, ranges string, kept string, n string, a string, text_key string, place string, bytes string, host string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000)) + " " + "z" * 200_000


def awkward_documents(spark):
    """NULL ids and texts, empty and blank texts, a very long one, ties, repeated rows, clashing columns."""
    prose = "The quick brown fox, being tired, slept. " * 3 + "It woke at noon; nobody minded, of course, and the day went on as any other day would have gone on."
    rows = [
        (1, prose), (2, None), (3, ""), (4, " \n\t "), (5, prose), (5, prose), (None, prose), (None, None), (6, LONG), (7, "one two"), (8, "One TWO"),
        (9, "ünï cödé \u2028 line | sep » x"), (10, prose + " tail"), (10, "another text under the same id"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


def corpus(seed=1, size=120):
    """Random texts with exact copies, near copies, shared passages and repeated lines."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(400)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(20, 60))] for _ in range(6)]
    texts = []
    for _ in range(size):
        kind = r.random()
        if texts and kind < 0.15:
            texts.append(r.choice(texts))
        elif texts and kind < 0.45:
            words = r.choice(texts).split(" ")
            for _ in range(r.randint(1, max(1, len(words) // 12))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            words = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
            if kind > 0.7:
                at = r.randint(0, len(words))
                words[at:at] = r.choice(passages)
            texts.append("\n".join(" ".join(words[i:i + 12]) for i in range(0, len(words), 12)))
    return list(enumerate(texts))


def rows_of(df):
    return [tuple(row) for row in df.collect()]
