import random
import zlib

import numpy as np
from cases import awkward_documents, empty_documents, rows_of

from contrastry.llm import toxicity
from contrastry.llm.recurrent import Encoder

INSULTS = ["grumble", "dolt", "blockhead"]
STEMS = ["zork"]


def prose(r, words=120, bad=0):
    said = ["".join(r.choice(["an", "re", "ti", "lo", "me", "su", "ka"]) for _ in range(r.randint(1, 4))) for _ in range(words)]
    for _ in range(bad):
        said[r.randrange(words)] = r.choice(INSULTS) if r.random() < 0.5 else r.choice(STEMS) + r.choice(["an", "ti", "lo", "ka", "su"]) + r.choice(["", "re"])
    return " ".join(said)


def labelled(r, size):
    """Toxic texts, one in six, hold four insults or words of a bad stem."""
    return [(i, prose(r, bad=4 if i % 6 == 0 else 0), int(i % 6 == 0)) for i in range(size)]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = Encoder("x", 4, 3)
    w = {k: v.astype(np.float64) for k, v in net.fresh(rng).items()}
    inputs, index, goal = rng.normal(size=(5, 4)), rng.integers(0, 5, (6, 2)), rng.normal(size=(2, 6))

    def loss():
        return float((net.forward(w, net.projected(w, inputs), index) * goal).sum())

    keep, grad = [], {k: np.zeros_like(v) for k, v in w.items()}
    gates = net.projected(w, inputs)
    net.forward(w, gates, index, keep)
    d_inputs = net.unprojected(w, inputs, net.backward(w, gates, index, keep, goal, grad), grad)
    for name, values, gradient in [*((k, w[k], grad[k]) for k in w), ("inputs", inputs, d_inputs)]:
        for at in rng.integers(0, values.size, 4):
            flat, old = values.reshape(-1), values.reshape(-1)[at]
            flat[at] = old + 1e-3
            above = loss()
            flat[at] = old - 1e-3
            below = loss()
            flat[at] = old
            assert abs((above - below) / 2e-3 - gradient.reshape(-1)[at]) < 1e-3 * max(1, abs(gradient.reshape(-1)[at])), name


def test_windows_cover_every_word_and_pieces_every_letter():
    texts = ["a b c", None, "", " . ", " ".join(f"w{i}" for i in range(130)), "x" * 100, "İstanbul ÜBER"]
    tokens = toxicity.Tokens(texts)
    text, start, size = toxicity.Tokens.windows(tokens)
    count = np.diff(tokens.first)
    assert count.tolist()[:5] == [3, 0, 0, 0, 130] and set(text.tolist()) == {0, 4, 5, 6}
    for t in range(len(texts)):
        covered = {int(s) + k for s, n in zip(start[text == t], size[text == t]) for k in range(n)}
        assert covered == set(range(int(tokens.first[t]), int(tokens.first[t + 1])))
    assert start[text == 4].tolist() == [s + int(tokens.first[4]) for s in (0, 24, 48, 72, 82)]  # by halves, the last one at the end
    assert count[5] == 12 and tokens.size[tokens.token[tokens.first[5]]] == 16


def test_held_out_accuracy_and_nothing_learned_from_held_out_rows(spark):
    r = random.Random(2)
    rows = labelled(r, 600)
    # the labels of held-out rows are turned round: whoever learned from them would fail
    labels = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows] + [(1, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    sample = toxicity.training_rows(docs, labels).collect()
    assert sample and not any(held(s["doc_id"]) for s in sample)
    got = dict(rows_of(toxicity.scored(docs, toxicity.train(docs, labels))))
    judged = [(got[i], y) for i, _, y in rows if held(i)]
    bad, good = [s for s, y in judged if y], [s for s, y in judged if not y]
    assert np.mean([b > g for b in bad for g in good]) > 0.97
    assert np.mean([s >= 0.7 for s in bad]) > 0.8 and np.mean([s >= 0.7 for s in good]) < 0.03
    long = " ".join([prose(r, 3_000), "you grumble dolt zorkti blockhead", prose(r, 3_000)])
    model = toxicity.train(docs, labels)
    whole, clean = toxicity.scores(model, [long, prose(r, 6_000)])
    assert whole > clean and whole >= 0.7  # the middle of a long text counts


def test_query_on_awkward_tables(spark, tmp_path):
    df = awkward_documents(spark)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 2)) for i in range(1, 9)] + [(3, 0), (3, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = toxicity.op11_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "doc_id long, text string")
    for values in ([], [(i, 0) for i in range(20)]):
        model = toxicity.train(docs, spark.createDataFrame(values, "doc_id long, toxic int"))
        assert len({r["score"] for r in toxicity.scored(docs, model).collect()}) == 1
    assert toxicity.scored(empty_documents(spark), model).count() == 0
