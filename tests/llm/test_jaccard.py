import random
import re

import numpy as np
import pytest
from cases import awkward_documents, corpus, empty_documents, rows_of

from contrastry.llm import jaccard
from contrastry.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, size=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_force(docs):
    sets = {d: grams(t) for d, t in docs}
    low = {d: d for d in sets}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                low[b] = a
    return sorted((d, len(sets[d]), root(d)) for d in ids)


@pytest.mark.parametrize("limit", [jaccard.REGION_BYTES, 2_000])
def test_classes_match_brute_force(spark, limit):
    """With the small limit nearly every region is split by distance to its centre."""
    docs = corpus(5, 150)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(rows_of(jaccard.jaccard_classes(df, limit=limit))) == brute_force(docs)


def test_awkward_rows(spark):
    got = sorted(rows_of(jaccard.jaccard_classes(awkward_documents(spark))), key=str)
    by = {}
    for d, n, c in got:
        by.setdefault(d, []).append((n, c))
    assert by[1] == [by[5][0]] and by[5] == [by[5][0]] * 2 and by[5][0][1] == 1
    assert by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[4] == [(0, 4)]
    assert by[7] == by[8] == [(1, 7)]
    assert sorted(by[None], key=str) == sorted([(by[1][0][0], 1), (0, None)], key=str)
    assert by[6][0][1] == 6 and by[6][0][0] == 60_001 - 4
    assert rows_of(jaccard.jaccard_classes(empty_documents(spark))) == []


def test_region_resolution_is_exact():
    r = random.Random(4)
    for _ in range(60):
        base = [set(r.sample(range(300), 40)) for _ in range(3)]
        sets = []
        for _ in range(r.randint(2, 25)):
            s = set(r.choice(base))
            for _ in range(r.randint(0, 9)):
                s.discard(r.choice(sorted(s)))
                s.add(r.randrange(300))
            sets.append(s)
        links = jaccard.resolve([np.array(sorted(s), np.uint64) for s in sets], 75)
        label = list(range(len(sets)))
        for a, b in links:
            assert 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
            label = [label[a] if x == label[b] else x for x in label]
        for i in range(len(sets)):
            for j in range(i):
                assert label[i] == label[j] or 100 * len(sets[i] & sets[j]) < 75 * len(sets[i] | sets[j])


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (7, 9), (9, 8), (1, 2)] + [(100 + i, 101 + i) for i in range(60)] + [(500, 501 + i) for i in range(50)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    assert {got[1], got[2], got[3]} == {1} and {got[7], got[8], got[9]} == {7}
    assert {got[100 + i] for i in range(61)} == {100} and {got[500 + i] for i in range(51)} == {500}
    assert rows_of(components(spark.createDataFrame([], "a long, b long"))) == []


def test_packed_counts_grow_with_the_n_grams_and_not_with_the_buckets(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(400)], "doc_id long, text string").coalesce(1)
    few, many = (docs.mapInArrow(jaccard.pack_grams("text", 5, b), jaccard.PACKED).selectExpr("sum(length(payload))").first()[0] for b in (4, 400))
    assert many < 1.3 * few
    owners = np.array([0, 0, 3, 255, 256, 900, 900])
    assert jaccard.unpack_steps(np.frombuffer(jaccard.pack_steps(owners), np.uint8)).tolist() == owners.tolist()


def test_a_passage_quoted_by_unrelated_texts_gathers_no_region(spark):
    """Each text has a near copy, and half of its n-grams are those of one passage in all texts."""
    r = random.Random(8)
    passage, rows = [f"p{k}" for k in range(60)], []
    for i in range(80):
        own = [f"o{i}x{k}" for k in range(60)]
        near = own.copy()
        near[r.randrange(60)] = f"n{i}"
        rows += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join(near + passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    measured, frequent = jaccard.measured_sets(docs, "text", 5)
    everything = np.full(1 << 10, 255, np.uint8)
    sets = jaccard.candidate_sets(docs, "text", 5, everything, jaccard.frequent_filter(frequent))
    assert jaccard.regions(sets, 75).groupBy("region").count().agg({"count": "max"}).first()[0] == 2
    assert sorted(rows_of(jaccard.jaccard_classes(docs))) == brute_force(rows)
