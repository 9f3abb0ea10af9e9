import gzip
import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward_documents, corpus, empty_documents, rows_of
from pyspark.sql import functions as F

from contrastry.llm import bpe, decontaminate, htmltext, warc
from contrastry.llm.wordhash import PUNCTUATION, Words
from contrastry.session import scratch_path

public_tokenizers = pytest.importorskip("public_tokenizers")


# ------------------------------------------------------------------ encoding
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def test_encoding_equals_the_library(library):
    vocabulary = bpe.loaded(bpe.vocabulary_source())
    r = random.Random(7)
    signs = [chr(c) for c in [*range(0x250), 0x85, 0x1680, 0x180E, 0x2028, 0x200B, 0x3000, 0x4E2D, 0x1F600, 0x300, 0x661, 0x2160]]
    texts = ["".join(r.choice(signs) if r.random() < 0.4 else r.choice(" etaoin\n'sxq019  ") for _ in range(r.randint(0, 90))) for _ in range(3000)]
    texts += [t for _, t in corpus(8, 60)] + ["", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "I'll 'S it's", "ab" * 4000, " " * 50 + "x"]
    for text, ids, known in zip(texts, vocabulary.encode_all(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == known.ids, text
        assert vocabulary.decode(ids).decode() == text


def test_bpe_rows_of_words_follow_the_rules_one_by_one(monkeypatch):
    vocabulary = bpe.Vocabulary(bpe.vocabulary_source())
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeinorst éñ日本") for _ in range(rng.randint(1, 20))) for _ in range(3000)] + ["a" * n for n in range(1, 90)]
    raw = [w.encode() for w in words]
    short = [w for w in raw if len(w) <= bpe.ROW_BYTES]
    sizes, flat = vocabulary.proposed_rows(short)
    assert [c.tolist() for c in np.split(flat, np.cumsum(sizes)[:-1])] == [vocabulary.proposed(w) for w in short]
    assert [ids.tolist() for ids in vocabulary.merged_rows(short)] == [vocabulary.merged(w) for w in short]
    vocabulary.learn(words)
    assert all(np.frombuffer(vocabulary.cache[w], "<u4").tolist() == vocabulary.merged(b) for w, b in zip(words, raw))
    # a full dictionary keeps the words that the slice at hand repeats
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    vocabulary.cache = {}
    learned = []
    learn = vocabulary.learn
    monkeypatch.setattr(vocabulary, "learn", lambda new: (learned.extend(new), learn(new)))
    for text in ("a b c d", "a b x y"):
        vocabulary.encode_all([text])
    assert sorted(learned) == [" b", " c", " d", " x", " y", "a"] and sorted(vocabulary.cache) == [" b", " x", " y", "a"]


def test_speculation_is_checked_and_repaired():
    """Some words are right at once, some pairs fail, and merging agrees with the checks."""
    vocabulary = bpe.loaded(bpe.vocabulary_source())
    words = [w.encode() for _, t in corpus(9, 40) for w in t.split(" ") if w]
    failing = 0
    for word in words:
        cut, merged = vocabulary.proposed(word), vocabulary.merged(word)
        good = vocabulary.compatible(np.array(cut[:-1]), np.array(cut[1:])).all() if len(cut) > 1 else True
        assert good == (cut == merged)
        failing += not good
    assert 0 < failing < len(words)


def test_encode_then_decode(spark):
    docs = awkward_documents(spark)
    coded = bpe.encode(docs)
    assert coded.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    back = bpe.decode(coded.drop("text"))
    assert sorted(map(str, rows_of(back.select("doc_id", "text")))) == sorted(map(str, rows_of(docs.select("doc_id", F.coalesce("text", F.lit(""))))))
    digests = rows_of(bpe.round_trip(docs).where("doc_id = 2"))
    empty = hashlib.sha256(b"").hexdigest()
    assert digests == [(2, 0, empty, empty)]
    assert bpe.round_trip(empty_documents(spark)).count() == 0 and bpe.encode(empty_documents(spark)).count() == 0


# ------------------------------------------------------------------ leaks
def word_distance(item, text):
    """Smallest edit distance of the item's words to any stretch of the text."""
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (a != b)))
        last = now
    return min(last)


def mutated(r, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at, kind = r.randrange(len(words)), r.random()
        if kind < 0.5:
            words[at] = r.choice(vocabulary)
        elif kind < 0.75:
            del words[at]
        else:
            words.insert(at, r.choice(vocabulary))
    return words


def test_recall_and_exact_distances():
    r = random.Random(2)
    vocabulary = [f"{r.choice('abcdefgh')}{r.randrange(300)}" for _ in range(500)]
    items = [[r.choice(vocabulary) for _ in range(r.choice((2, 3, 5, 9, 15, 30, 60)))] for _ in range(60)]
    known = decontaminate.Items(list(range(60)), [" ".join(i) for i in items])
    for share, least in ((0.0, 1.0), (0.1, 0.98), (0.2, 0.95), (0.25, 0.9)):
        texts, expected = [], set()
        for row in range(200):
            i = r.randrange(60)
            body = mutated(r, items[i], int(share * len(items[i])), vocabulary)
            body = [r.choice(vocabulary) for _ in range(r.randint(0, 40))] + body + [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
            texts.append(body)
            if word_distance(items[i], body) <= decontaminate.edits(len(items[i])):
                expected.add((row, i))
        words = Words(pa.array([" ".join(t).upper().replace(" ", ", ") for t in texts]), lower=True, separator=PUNCTUATION)
        found = {}
        for row, i, distance, _ in known.verified(words):
            found[row, i] = min(distance, found.get((row, i), 99))
        assert len(expected & set(found)) >= least * len(expected)
        for (row, i), distance in found.items():
            assert distance <= decontaminate.edits(len(items[i])) and distance >= word_distance(items[i], texts[row])
            assert share or distance == word_distance(items[i], texts[row])


def test_pairs_are_verified_together_within_a_bound():
    r = np.random.default_rng(3)
    for widths in ([], [5], [decontaminate.CELLS * 3], [10] * 2_500, [decontaminate.CELLS // 2] * 5 + [decontaminate.CELLS + 1, 7], np.sort(r.integers(1, 60_000, 4_000)).tolist()):
        runs = list(decontaminate.together(np.array(widths, np.int64)))
        assert [i for begin, end in runs for i in range(begin, end)] == list(range(len(widths)))
        for begin, end in runs:
            assert end - begin == 1 or (end - begin <= decontaminate.PAIRS and (end - begin) * max(widths[begin:end]) <= decontaminate.CELLS)


def test_wide_stretches_and_long_items():
    item, width = np.array([11, 12, 13], np.uint64), (1 << 20) + 50
    text = np.ones(width, np.uint64)
    text[-20:-18] = item[[0, 2]]  # the word between is missing
    best, begins = decontaminate.semi_global(text, np.array([0]), np.array([width]), item, np.array([0]), np.array([3]))
    assert (best.tolist(), begins.tolist()) == ([1], [width - 20])
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    body = [r.choice(vocabulary) for _ in range(2_000)]
    copy = mutated(r, body, 300, vocabulary)
    known = decontaminate.Items([7], [" ".join(body)])
    words = Words(pa.array([" ".join(["before"] * 30 + copy + ["after"] * 30), "another text"]), lower=True, separator=PUNCTUATION)
    found = list(known.verified(words))
    assert {(row, item) for row, item, *_ in found} == {(0, 0)} and min(f[2] for f in found) == word_distance(body, copy)


def test_recall_of_long_items():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[r.choice(vocabulary) for _ in range(r.choice((65, 130, 400, 900)))] for _ in range(30)]
    known = decontaminate.Items(list(range(30)), [" ".join(i) for i in items])
    for share in (0.0, 0.15, 0.25):
        texts = [[r.choice(vocabulary) for _ in range(r.randint(0, 90))] + mutated(r, item, int(share * len(item)), vocabulary) + [r.choice(vocabulary)] * r.randint(0, 90) for item in items]
        words = Words(pa.array([" ".join(t) for t in texts]), lower=True, separator=PUNCTUATION)
        found = {}
        for row, item, distance, _ in known.verified(words):
            found[row, item] = min(distance, found.get((row, item), len(texts[row])))
        assert len([i for i in range(30) if (i, i) in found]) >= 0.9 * 30 and all(row == item for row, item in found)
        for (row, item), distance in list(found.items())[:10]:
            assert distance == word_distance(items[item], texts[row])


def test_leaks_of_awkward_rows(spark):
    items = spark.createDataFrame([(1, "It woke at NOON nobody minded of course"), (2, None), (3, ""), (4, "?!"), (5, "one two"), (5, "one two"), (None, "the quick brown fox")], "item_id long, text string")
    got = rows_of(decontaminate.leaks(awkward_documents(spark), items).select("doc_id", "item_id", "distance"))
    assert sorted(got, key=str) == sorted([(d, i, 0) for d in (1, 5, 10, None) for i in (1, -1)] + [(7, 5, 0), (8, 5, 0)], key=str)
    kept = decontaminate.without_leaks(awkward_documents(spark), items)
    assert kept.columns == awkward_documents(spark).columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(["2", "3", "4", "6", "9", "10", "None"])
    assert decontaminate.leaks(empty_documents(spark), items).count() == 0
    assert decontaminate.leaks(awkward_documents(spark), items.limit(0)).count() == 0
    assert decontaminate.without_leaks(awkward_documents(spark), items.limit(0)).count() == awkward_documents(spark).count()


# ------------------------------------------------------------------ pages
def test_held_out_accuracy(spark):
    model = htmltext.Model(htmltext.train(htmltext.labelled_pages(spark)))
    right = total = 0
    for seed in range(50_000, 50_200):
        page = htmltext.Page(htmltext.Grammar(seed).page())
        states, chances = page.labels(), model.marginals(page)
        right += sum((chances[n] >= 0.5) == (states[n] == htmltext.CONTENT) for n in page.texts)
        total += len(page.texts)
    assert right / total > 0.985
    assert model.extract(
        '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav>'
        '<div class="ad">Buy now, it is cheap.</div><article><h1>Head &amp; line</h1><p><b>First\n  part.<br><p>Second &#233;&nbsp;one, here.</article>'
        '<div class="comments"><p>I liked this article, it was good to read.</p></div><footer>&copy; x &middot; y.</footer>'
    ) == "Head & line\n\nFirst part.\n\nSecond é one, here."
    assert model.extract("") == "" and isinstance(model.extract("<<<a <b <!-- x"), str)


def test_marginals_match_enumeration(spark):
    from itertools import product
    from math import exp

    model = htmltext.Model({("edge", 2, 1): 3, ("edge", 2, 0): 2, ("edge", 1, 1): 5, ("edge", 2, 2): 2, ("block", 1, 1): 4, ("block", 0, 0): 4, ("tag=p", 1, 0): 3, ("tag=nav", 0, 0): 2,
                            ("state", 0, 0): 4, ("state", 0, 1): 6, ("state", 0, 2): 3, ("tag=body", 2, 0): 2})
    page = htmltext.Page("<body><nav>x</nav><p>y</p></body>")
    size, weight = len(page.parents), {}
    for states in product(htmltext.STATES, repeat=size):
        p = model.root[states[0]]
        for i in range(size):
            for f in page.features[i]:
                if f in model.emit:
                    p *= exp(model.emit[f][states[i]] * (htmltext.BLOCK_WEIGHT if i in page.texts else 1))
            if i:
                p *= model.edges[page.edge_kind(i)][states[page.parents[i]]][states[i]]
        weight[states] = p
    total = sum(weight.values())
    for i, chance in enumerate(model.marginals(page)):
        assert abs(chance - sum(p for s, p in weight.items() if s[i] == htmltext.CONTENT) / total) < 1e-9


def test_pages_of_awkward_rows(spark):
    counts = htmltext.train(htmltext.labelled_pages(spark, 60))
    pages = spark.createDataFrame([(1, None, "x", "y"), (2, "", "x", "y"), (None, "<p>a</p>" * 20_000, "x", "y"), (3, "<article><p>One, two.</p></article>", "x", "y"), (3, "<article><p>One, two.</p></article>", "x", "y")],
                                  "page_id long, html string, text string, n_chars string")
    out = htmltext.main_text(pages, counts)
    assert out.columns == ["page_id", "text", "n_chars"]
    assert rows_of(out.where("page_id < 3").orderBy("page_id")) == [(1, "", 0), (2, "", 0)] and rows_of(out.where("page_id = 3")) == [(3, "One, two.", 9)] * 2
    assert htmltext.main_text(pages.limit(0), counts).count() == 0


# ------------------------------------------------------------------ archives
def test_archives_round_trip(spark):
    big = "é" * 80
    rows = [(3, "http://a/\n x", big), (1, "http://b/", big), (2, None, "short"), (4, "http://c/", "short"), (5, "u", None), (None, "u", big), (6, "u", "a\r\n\r\nWARC/1.1\r\n" * 9), (7, "u", "x" * 3_000_000), (1, "http://b/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    raw, target = scratch_path(spark, "raw"), scratch_path(spark, "warc")
    warc.write_monolithic(warc.with_roles(pages), raw, records=3)
    done = warc.normalise(spark, raw, target).collect()
    assert sum(r["records"] for r in done) == len(rows) and len(done) >= 3
    got = warc.read_records(warc.read_index(spark, target), target).collect()
    body = {(r["page_id"], r["record_type"]): r for r in got}
    assert len(got) == len(rows) and [r["record_type"] for r in got if r["page_id"] == 1] == ["response"] * 2
    assert body[3, "revisit"]["refers_to"] == 1 and body[3, "revisit"]["payload_bytes"] == 160 and body[3, "revisit"]["payload"] is None
    assert body[None, "revisit"]["refers_to"] == 1 and body[3, "revisit"]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest()
    assert body[2, "response"]["payload"] == body[4, "response"]["payload"] == "short" and body[5, "response"]["payload"] == ""
    assert body[6, "response"]["payload"] == rows[6][2] and body[7, "response"]["payload_bytes"] == 3_000_000
    local = target.removeprefix("file:")
    names = sorted(os.listdir(local))
    assert all(n.endswith((".warc.gz", ".cdxj")) for n in names if not n.startswith("."))
    whole = b"".join(gzip.open(os.path.join(local, n)).read() for n in names if n.endswith(".gz"))
    assert whole.count(b"WARC-Type: ") == len(rows)


def test_empty_archives(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    raw, target = scratch_path(spark, "raw"), scratch_path(spark, "warc")
    warc.write_monolithic(warc.with_roles(pages), raw)
    warc.normalise(spark, raw, target).collect()
    assert warc.read_records(warc.read_index(spark, target), target).count() == 0


def test_records_survive_any_cut():
    record = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 5\r\n\r\nab\r\n\r\r\n\r\n"
    whole = record * 7
    for step in (1, 3, 17, 1000):
        pieces = (whole[i:i + step] for i in range(0, len(whole), step))
        assert [r for _, r in warc.records_of(pieces)] == [record] * 7
    with pytest.raises(ValueError):
        list(warc.records_of(iter([whole[:-1]])))


def test_head_ends_without_its_end_tag_or_a_body_tag():
    words = "The article goes on, as articles do, and says a good deal. " * 3
    for page in (f"<html><head><title>T</title><meta charset=x><p>{words}<p>{words}", f"<head><title>T</title><a href=x>{words}</a>", f"<head><title>T</title>{words}"):
        texts = list(htmltext.Page(page).texts.values())
        assert texts and all(t == words.strip() for t in texts), page
    assert list(htmltext.Page("<head><title>T</title><noscript><p>no</p></noscript><script>x</script></head><body><p>yes").texts.values()) == ["yes"]


def test_cut_archives_are_refused(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 30) for i in range(7)], "page_id long, url string, html string")
    whole = b"".join(f"WARC/1.1\r\nContent-Length: 3\r\n\r\nab{i}\r\n\r\n".encode() for i in range(7))
    packer = __import__("zlib").compressobj(5, 8, 31)
    flushed = packer.compress(whole[:len(whole) // 7 * 3]) + packer.flush(__import__("zlib").Z_FULL_FLUSH)
    rest = packer.compress(whole[len(whole) // 7 * 3:]) + packer.flush()
    import io

    assert len(list(warc.records_of(warc.inflated(io.BytesIO(flushed + rest))))) == 7
    for cut in (flushed, flushed + rest[:-1], flushed + rest[:-8]):
        with pytest.raises(ValueError):
            list(warc.records_of(warc.inflated(io.BytesIO(cut))))
    assert warc.rooted(spark, "s3://bucket/x", "y") == "s3://bucket/x"
    warc.write_monolithic(warc.with_roles(pages), str(tmp_path / "raw"))
    assert warc.rooted(spark, str(tmp_path / "out"), str(tmp_path / "raw")).startswith("file:")


def blocks_of(html):
    return list(htmltext.Page(html).texts.values())


def test_silence_ends_with_its_element():
    assert blocks_of("<p>before</p><button>ok<p>one</p><p>two</p>") == ["before", "one", "two"]
    assert blocks_of("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>") == ["a x=1 b"]
    assert blocks_of("<p>a<script>var x;</script>b <svg><path d=1><text>t</text></svg>c</p>") == ["ab c"]
    assert blocks_of("<div><button>Menu</button> text</div>") == ["text"] and blocks_of("<select><option>a<option>b</select><p>c") == ["c"]
    assert blocks_of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"] and blocks_of("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]


def test_deep_and_unclosed_pages_take_time_in_proportion():
    import time

    def took(size):
        start = time.process_time()
        page = htmltext.Page("<b>" * size + "<p>x" * size + "<div>" * size + "y")
        assert len(page.texts) == size + 1
        return time.process_time() - start

    took(1_000)
    assert took(40_000) < 10
