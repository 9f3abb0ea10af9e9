import hashlib
import random
import re
import zlib

import numpy as np
from cases import awkward_documents, corpus, empty_documents, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from contrastry.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(words, exponent=4, least=6):
    """Every stretch of smallest period q, by definition: (start, length, q)."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q):
                part = words[i:i + size]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = runs_of(words)
    out = set()
    for start, length, q in runs:
        out.update(range(start + q, start + length))
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best[1] * 1000 // best[2] if best else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in out)))


def found(words, **how):
    return [tuple(r) for r in periodic.find_runs(np.array(words, np.uint64), np.zeros(len(words), np.int64), **how).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=6))
def test_runs_of_joined_repetitions(parts):
    words = [w for part, times in parts for w in part * times]
    assert found(words) == runs_of(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60), st.integers(2, 6), st.integers(2, 12))
def test_other_exponents_and_lengths(words, exponent, least):
    assert found(words, exponent=exponent, least=least) == runs_of(words, exponent, least)


def test_texts_of_a_slice_do_not_meet():
    codes, text = np.array([5] * 12, np.uint64), np.repeat([0, 1, 3], [5, 6, 1])
    assert periodic.find_runs(codes, text).tolist() == [[5, 6, 1]]


def test_long_words_without_and_with_structure():
    assert found([1] * 100_000) == [(0, 100_000, 1)]
    assert found([i % 20_000 for i in range(90_000)]) == [(0, 90_000, 20_000)]
    assert found([bin(i).count("1") % 2 for i in range(1 << 15)]) == []  # no overlaps in this sequence
    assert len(found(sum(([1] * 6 + [100 + i] for i in range(20_000)), []))) == 20_000
    assert found([1] * 5) == [] and found([1] * 6) == [(0, 6, 1)] and found([1, 2] * 3 + [1]) == [] and found([1, 2] * 4) == [(0, 8, 2)]


def test_query_matches_brute_force(spark, tmp_path):
    r = random.Random(4)
    docs = corpus(8, 250)
    docs += [(1_000 + i, " ".join(r.choice("abc") for _ in range(r.randint(0, 80)))) for i in range(150)]
    docs += [(2_000, "stop " * 400), (2_001, "x\ty\n" * 50 + "end"), (2_002, None), (2_003, ""), (2_004, " \n"), (None, "no no no no no no no"), (2_005, "a b " * 4), (2_005, "a b " * 4)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(periodic.op13_periodic_runs(spark, str(tmp_path)))
    want = [expected(d, t) for d, t in docs]
    assert any(d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs) and sum(w[1] > 0 for w in want) > 30
    assert sorted(got, key=str) == sorted(want, key=str)


def test_interface_gives_runs_and_collapsed_text(spark):
    df = spark.createDataFrame([(1, "so very very very very very very good", "clash")], "doc_id long, text string, runs string")
    row = periodic.periodic_runs(df).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 6, 1)] and row["collapsed"] == "so very good"


def test_awkward_rows(spark):
    df = awkward_documents(spark)
    rows = periodic.periodic_runs(df).collect()
    assert len(rows) == df.count() and all(r["collapsed"] is not None for r in rows)
    assert periodic.periodic_runs(empty_documents(spark)).count() == 0
