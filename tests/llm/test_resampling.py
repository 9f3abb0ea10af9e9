import hashlib
import math
import re
import zlib

from cases import awkward_documents, corpus, empty_documents, rows_of

from contrastry.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def drawn(docs, target):
    """Plain version: rows (doc_id, n_features, weight, score, rank), ranks by score, then id."""
    s, t = [0] * 10_000, [0] * 10_000
    held = [(d, *features(x)) for d, x in docs]
    for _, _, found in held:
        for b in found:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    out = []
    for d, words, found in held:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, row in enumerate(able[:25 * len(able) // 100]):
        row[4] = k + 1
    return sorted(map(tuple, out), key=str)


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]


def check(spark, docs, target):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    assert sorted(rows_of(resampling.resample(df, wanted).select(COLUMNS)), key=str) == drawn(docs, target)


def test_draw_matches_brute_force(spark):
    docs = corpus(5, 150)
    check(spark, docs, [docs[3][1], docs[70][1], "Café 42 cafés, the END"])


def test_boundaries_of_documents_case_and_characters(spark):
    docs = [(1, "a b"), (2, "c d"), (3, "ÀB{cd}~E\x7ff\x00g"), (4, None), (5, ""), (6, ".,;"), (None, "word " * 25), (7, "z" * 300_000 + " tail " * 30), (8, "ABC abc Abc " * 9)]
    check(spark, docs, ["b c", "a b", None, "abc"])


def test_without_target_and_without_documents(spark):
    docs = corpus(6, 40)
    check(spark, docs, [])
    wanted = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows_of(resampling.resample(empty_documents(spark), wanted)) == []


def test_awkward_rows_stay_and_repeated_rows_get_ranks_of_their_own(spark):
    df = awkward_documents(spark)
    wanted = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    rows = resampling.resample(df, wanted, percent=100).collect()
    assert len(rows) == df.count()
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert ranks == list(range(1, 1 + sum(r["n_words"] >= 20 for r in rows)))
    assert sum(r["doc_id"] == 5 and r["rank"] is not None for r in rows) == 2


def test_longer_ngrams_and_a_rerun_draw_the_same(spark):
    docs = spark.createDataFrame(corpus(7, 60), "doc_id long, text string")
    first, again = (sorted(rows_of(resampling.resample(docs.repartition(n), docs.limit(3), longest=3)), key=str) for n in (1, 5))
    assert first == again
