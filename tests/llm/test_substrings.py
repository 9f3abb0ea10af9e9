import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward_documents, corpus, empty_documents, rows_of

from contrastry.llm import substrings
from contrastry.llm.wordhash import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(docs, window=20):
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for p in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][p:p + window]), (d, p))
    out = []
    for d, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] != (d, p):
                gone.update(range(p, p + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 20, 1 << 9])
def test_matches_brute_force(spark, cells):
    """A sketch that is far too small lets everything through and changes nothing."""
    docs = corpus(2, 150) + [(900, "a " * 90), (901, "a b " * 40 + "c"), (902, "a " * 25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(rows_of(substrings.without_repeats(df, digest=True, cells=cells))) == brute_force(docs)


def test_awkward_rows(spark):
    got = rows_of(substrings.without_repeats(awkward_documents(spark), cells=1 << 20))
    by = {}
    for d, n, removed, kept in got:
        by.setdefault(d, []).append((n, removed, kept))
    n = by[1][0][0]
    assert by[1][0][1] == 0 and by[5] == [(n, n, "")] * 2 and (n, n, "") in by[None] and (0, 0, "") in by[None]
    assert by[2] == by[3] == by[4] == [(0, 0, "")]
    assert by[6][0][:2] == (60_001, 0)
    assert sorted(x[2] for x in by[10]) == ["another text under the same id", "tail"]
    assert rows_of(substrings.without_repeats(empty_documents(spark), cells=1 << 20)) == []


def test_anchor_is_the_first_smallest():
    h = np.random.default_rng(1).integers(0, 9, 300).astype(np.uint64)
    at = substrings.smallest(h, 11)
    assert all(at[i] == i + int(np.argmin(h[i:i + 11])) for i in range(len(at)))


def test_words_at_row_borders():
    column = pa.array(["ab", "cd ef", None, "", " x", "y"])
    words = Words(column)
    assert words.counts().tolist() == [1, 2, 0, 0, 1, 1]
    assert [bytes(words.data[a:b]) for a, b in zip(words.start, words.end)] == [b"ab", b"cd", b"ef", b"x", b"y"]
    assert words.hash[0] == Words(pa.array(["q ab"])).hash[1]
