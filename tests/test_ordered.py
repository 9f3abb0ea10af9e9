"""Kernels against brute force, including ties and one group holding most rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrastry.functions import expr, ordered


def _skewed(n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}"
        value = 0.0 if rng.random() < 0.3 else rng.choice([rng.uniform(-50, 50), rng.randrange(10), 10 ** rng.uniform(-3, 6)])
        rows.append((key, i, float(value)))
    return rows


def _by_key(rows):
    out = {}
    for k, i, v in rows:
        out.setdefault(k, []).append((i, v))
    return out


def test_quantiles_match_numpy(spark):
    rows = _skewed()
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = {r.k: r for r in ordered.group_quantiles(df, ["k"], "v", {"med": 0.5, "q": 0.9}, mean="mean", count="n").collect()}
    for k, pairs in _by_key(rows).items():
        values = [v for _, v in pairs]
        assert got[k].med == pytest.approx(float(np.median(values)), rel=1e-12, abs=1e-12)
        assert got[k].q == pytest.approx(float(np.quantile(values, 0.9)), rel=1e-9)
        assert got[k]["mean"] == pytest.approx(float(np.mean(values)), rel=1e-9)
        assert got[k].n == len(values)


def test_weighted_quantile_repeats_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", 9.0, 2)], "k string, v double, w long")
    assert ordered.group_quantiles(df, ["k"], "v", {"m": 0.5}, weight="w").first().m == 3.0


@pytest.mark.parametrize("descending", [False, True])
def test_mid_rank_matches_brute_force(spark, descending):
    rows = _skewed(1200, 5)
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = {(r.k, r.i): (r["rank"], r.n) for r in ordered.mid_rank(df, ["k"], "v", "rank", total="n", descending=descending).collect()}
    for k, pairs in _by_key(rows).items():
        for i, v in pairs:
            below = sum((x > v) if descending else (x < v) for _, x in pairs)
            ties = sum(x == v for _, x in pairs)
            assert got[(k, i)] == (below + (ties + 1) / 2, len(pairs))


def test_row_rank_is_a_permutation_with_ties_by_key(spark):
    rows = _skewed(1000, 8)
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = {(r.k, r.i): r.place for r in ordered.row_rank(df, ["k"], "v", ["i"], "place").collect()}
    for k, pairs in _by_key(rows).items():
        want = [i for i, _ in sorted(pairs, key=lambda p: (-p[1], p[0]))]
        assert [i for i, _ in sorted(((i, got[(k, i)]) for i, _ in pairs), key=lambda p: p[1])] == want


def test_text_and_hash_ranks(spark):
    df = spark.createDataFrame([("g", f"file{i:03d}") for i in range(200)], "k string, f string")
    text = [r.f for r in ordered.text_rank(df, ["k"], ["f"], "p").orderBy("p").collect()]
    assert text == sorted(text)
    hashed = ordered.hash_rank(df, ["k"], F.md5("f"), ["f"], "p", total="n").orderBy("p").collect()
    assert [r.p for r in hashed] == list(range(1, 201)) and hashed[0].n == 200
    import hashlib
    assert [r.f for r in hashed] == sorted(text, key=lambda f: hashlib.md5(f.encode()).hexdigest())


def _bh(p):
    p = np.clip(np.nan_to_num(np.array(p), nan=1.0), 0, 1)
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty_like(q)
    out[order] = np.clip(q, 0, 1)
    return out


def test_bh_matches_reference_rule_and_is_monotone(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"f{i % 7}", i, rng.choice([rng.random() ** 6, 0.04, 1.0, float("nan"), 1e-300])) for i in range(900)]
    df = spark.createDataFrame(rows, "f string, i long, p double")
    got = {r.i: r.q for r in ordered.bh_q_values(df, ["f"], "p", "q").collect()}
    for f in {r[0] for r in rows}:
        mine = [(i, p) for g, i, p in rows if g == f]
        want = _bh([p for _, p in mine])
        assert [got[i] for i, _ in mine] == pytest.approx(list(want), rel=1e-12)


def test_bh_five_values(spark):
    df = spark.createDataFrame([("a", float(p)) for p in (0.01, 0.02, 0.03, 0.04, 0.05)], "f string, p double")
    assert [r.q for r in ordered.bh_q_values(df, ["f"], "p", "q").collect()] == pytest.approx([0.05] * 5)


def test_spearman_and_degenerate(spark):
    df = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(5)] + [("b", 1.0, float(i)) for i in range(5)], "k string, x double, y double")
    got = {r.k: r.rho for r in ordered.spearman(df, ["k"], "x", "y", "rho", degenerate=0.0).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == 0.0


def test_erfc_and_log_factorial(spark):
    xs = [0.0005 * i * i for i in range(1, 220)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", expr.erfc(F.col("x")).alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-12)
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 10, 500, 61199)], "n long")
    for r in df.select("n", expr.log_factorial(F.col("n")).alias("l")).collect():
        assert r.l == pytest.approx(math.lgamma(r.n + 1), abs=2e-10)


def test_hypergeometric_tail_exact(spark):
    cases = [(3, 100, 10, 12), (0, 50, 5, 5), (1, 20000, 400, 3000), (5, 150, 40, 30), (30, 150, 148, 30), (4, 10, 5, 8)]
    df = spark.createDataFrame(cases, "k long, big long, m long, d long")
    for r in df.select("*", expr.hypergeometric_tail(F.col("k"), F.col("big"), F.col("m"), F.col("d")).alias("p")).collect():
        exact = sum(math.comb(r.m, i) * math.comb(r.big - r.m, r.d - i) for i in range(r.k, min(r.m, r.d) + 1)) / math.comb(r.big, r.d)
        assert r.p == pytest.approx(exact, rel=1e-8)


def test_no_window_over_a_whole_group_of_measurements(spark):
    """The plan of a grouped median partitions its value windows by (group, block)."""
    df = spark.createDataFrame(_skewed(50), "k string, i long, v double")
    plan = ordered.group_quantiles(df, ["k"], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [sum(_n" in line and "_v#" in line]
    assert windows and all("_block#" in line for line in windows)


def test_ranks_do_not_depend_on_prefix_ties_or_range(spark):
    """One shared prefix, half the rows tied, values in a narrow range."""
    names = [f"TCGA-AB-{(i * 7919) % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([("g", n) for n in names] + [("h", "TCGA")], "k string, f string")
    got = {(r.k, r.f): r.p for r in ordered.text_rank(df, ["k"], ["f"], "p").collect()}
    assert [got["g", n] for n in sorted(names)] == list(range(1, 1001)) and got["h", "TCGA"] == 1
    every = ordered.ordered_rank(df, [], [F.col("f").desc(), F.col("k")], "p", total="n").collect()
    assert [r.f for r in sorted(every, key=lambda r: r.p)] == sorted([*names, "TCGA"], reverse=True) and {r.n for r in every} == {1001}
    values = [1.7e9 + (0 if i % 2 else i) for i in range(600)]
    mid = ordered.mid_rank(spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "k string, i long, v double"), ["k"], "v", "r", total="n")
    ranks = {r.i: (r.r, r.n) for r in mid.collect()}
    assert all(ranks[i] == (sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2, 600) for i, v in enumerate(values))


def test_mid_rank_windows_hold_cells_not_rows(spark):
    df = spark.createDataFrame(_skewed(50), "k string, i long, v double")
    plan = ordered.mid_rank(df, ["k"], "v", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block#" in line or "_cell" not in line for line in plan.splitlines() if "Window" in line)
    assert not any("i#" in line for line in plan.splitlines() if "Window [" in line)


def test_student_t_quantiles(spark):
    # Two-sided 95 % quantiles of published tables.
    known = {1: 12.7062, 2: 4.30265, 3: 3.18245, 4: 2.77645, 5: 2.57058, 9: 2.26216, 19: 2.09302, 20: 2.08596, 99: 1.98422, 199: 1.97196, 999: 1.96234}
    df = spark.createDataFrame([(n,) for n in [0, *known]], "n long").select("n", expr.student_t_quantile(F.col("n")).alias("t"))
    got = {r.n: r.t for r in df.collect()}
    assert got.pop(0) is None and got == pytest.approx(known, abs=6e-5)


def test_replicates_match_repeated_rows(spark):
    from contrastry.functions import replicates

    rng = random.Random(12)
    rows = [(k, arm, rng.choice([0.0, float(rng.randrange(5)), rng.uniform(-3, 900)]), [rng.choice((0, 0, 1, 1, 2, 5)) for _ in range(5)]) for k in ("a", "b") for arm in "tn" for _ in range(60)]
    rows += [("alone", "t", 1.0, [1, 0, 1, 0, 1]), ("alone", "n", 1.0, [1, 1, 0, 0, 1])]
    df = spark.createDataFrame(rows, "k string, arm string, v double, times array<int>")
    numbers = [-1, 0, 1, 2, 3]
    medians = {(r.k, r.arm, r.replicate): r.m for r in replicates.replicated_quantile(df, ["k", "arm"], "v", "times", numbers, "m").collect()}
    upper = {(r.k, r.arm, r.replicate): r.m for r in replicates.replicated_quantile(df, ["k", "arm"], "v", "times", numbers, "m", 0.9).collect()}
    effects = {(r.k, r.replicate): (r.effect, r.median_t, r.median_n) for r in replicates.replicated_rank_effects(df, ["k"], "arm", "v", "times", numbers).collect()}
    for k in ("a", "b", "alone"):
        for i, number in enumerate(numbers):
            repeated = {arm: [v for kk, a, v, times in rows if kk == k and a == arm for _ in range(times[i])] for arm in "tn"}
            for arm, values in repeated.items():
                if values:
                    assert medians[k, arm, number] == pytest.approx(float(np.median(values)), rel=1e-12)
                    assert upper[k, arm, number] == pytest.approx(float(np.quantile(values, 0.9)), rel=1e-9)
                else:
                    assert (k, arm, number) not in medians
            t, n = repeated["t"], repeated["n"]
            if t and n:
                u = sum((x > y) + 0.5 * (x == y) for x in t for y in n)
                assert effects[k, number][0] == pytest.approx(2 * u / (len(t) * len(n)) - 1, abs=1e-12)
                assert effects[k, number][1:] == (pytest.approx(float(np.median(t))), pytest.approx(float(np.median(n))))
            else:
                assert (k, number) not in effects


def test_unit_medians_move_rows_and_hold_no_map_of_a_group(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", None, *"abcdefgh"]), "x", rng.choice([None, float("nan"), 0.0, rng.uniform(-9, 9), float(rng.randrange(4))]), rng.choice([None, rng.uniform(0, 1)])) for _ in range(2_000)]
    rows += [("one", "x", 1.5, 2.5), ("blank", "x", None, 1.0), ("two", "x", 1e308, 4.0), ("two", "x", 1.7e308, 5.0)]
    df = spark.createDataFrame(rows, "k string, l string, v double, w double")
    got = ordered.unit_medians(df, ["k", "l"], {"m": "v", "o": "w"})
    want = df.groupBy("k", "l").agg(F.median("v").alias("m"), F.median("w").alias("o")).dropna(subset=["m", "o"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == ["k", "l", "m", "o"]
