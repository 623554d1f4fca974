import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import resample as S


def sums(spark, rows):
    return S.cluster_sums(spark.createDataFrame(rows, "g string, c string, v double"), ["g"], "c", F.col("v"))


def p_exact(spark, rows):
    return {r.g: r.p for r in S.sign_flip_exact(sums(spark, rows), ["g"]).collect()}


def test_known_sign_flips(spark):
    rows = [("k", "a", 1.0), ("k", "a", 1.0), ("k", "b", 1.0), ("k", "c", -1.0), ("up", "a", 1.0), ("up", "b", 2.0), ("up", "c", 3.0), ("one", "a", 1.0), ("zero", "a", 0.0), ("zero", "b", 0.0), ("zero", "b", None)]
    assert p_exact(spark, rows) == {"k": 3 / 8, "up": 1 / 8, "one": None, "zero": 1.0}


def test_sampled_sign_flip_is_near_the_exact_one(spark):
    rng = np.random.default_rng(0)
    rows = [("g", f"c{i}", float(x)) for i, x in enumerate(rng.normal(0.4, 1, 12))]
    exact = p_exact(spark, rows)["g"]
    got = S.sign_flip_sampled(sums(spark, rows), ["g"], 4000, 1).first()
    assert got.n_clusters == 12 and abs(got.p - exact) < 0.03
    assert S.sign_flip_sampled(sums(spark, [("z", "a", 0.0), ("z", "b", 0.0)]), ["g"], 50, 1).first().p == 1.0
    assert S.sign_flip_sampled(sums(spark, [("z", "a", 1.0)]), ["g"], 50, 1).first().p is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=2, max_size=6))
def test_exact_p_by_enumeration(spark, values):
    rows = [("g", f"c{i}", float(v)) for i, v in enumerate(values)]
    nulls = [sum(s * v for s, v in zip(signs, values)) for signs in itertools.product([1, -1], repeat=len(values))]
    want = 1.0 if not any(values) else np.mean([n >= sum(values) - 1e-9 for n in nulls])
    assert p_exact(spark, rows)["g"] == pytest.approx(want)


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [("g", f"c{i % 8}", float(x)) for i, x in enumerate(rng.normal(1, 1, 60))] + [("one", "a", 2.0), ("one", "a", 4.0)]
    got = {r.g: r for r in S.bootstrap_means(sums(spark, rows), ["g"], 500, 42).collect()}
    table = sums(spark, rows).where("g = 'g'").toPandas()
    point, low, high = S.bootstrap_numpy(table, 500, 42)
    assert got["g"].point == pytest.approx(point) and got["g"].low <= point <= got["g"].high
    assert abs(got["g"].low - low) < 0.15 and abs(got["g"].high - high) < 0.15
    assert got["one"].point == 3.0 and got["one"].low is None
    poisson = {r.g: r for r in S.bootstrap_poisson(sums(spark, rows), ["g"], 2000, 1).collect()}
    assert poisson["g"].point == pytest.approx(point) and abs(poisson["g"].low - low) < 0.2 and abs(poisson["g"].high - high) < 0.2
    assert poisson["one"].n_clusters == 1 and poisson["one"].low is None


def test_numpy_bootstrap_is_a_plain_cluster_bootstrap():
    rows = pd.DataFrame({"c": list("aabbbc"), "v": [1.0, 2, 3, 4, 5, 6]})
    table = rows.groupby("c")["v"].agg(["sum", "count"]).reset_index().set_axis(["cluster", "s", "n"], axis=1)
    rng, means = np.random.default_rng(7), []
    for _ in range(200):
        drawn = rng.integers(0, 3, 3)
        means.append(pd.concat([rows[rows.c == "abc"[k]] for k in drawn])["v"].mean())
    assert S.bootstrap_numpy(table, 200, 7) == pytest.approx((3.5, *np.percentile(means, [2.5, 97.5])))


def test_metric_bootstrap(spark):
    df = spark.createDataFrame([("g", f"c{i % 5}", float(i)) for i in range(30)] + [("h", "a", 1.0)], "g string, c string, v double")
    got = {r.g: r for r in S.bootstrap_metric(df, ["g"], "c", lambda p: p["v"].median(), 100, 1).collect()}
    assert got["g"].point == 14.5 and got["g"].low <= 14.5 <= got["g"].high and got["h"].point == 1.0 and got["h"].low is None


def test_permutation_within_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [("g", f"c{i % 10}", f"r{i}", float(s), float(s)) for i, s in enumerate(rng.choice([-1.0, 1.0], 80))]
    df = spark.createDataFrame(rows, "g string, c string, row string, l double, r double")
    got = S.within_cluster_permutation(df, ["g"], "c", "row", F.col("l"), F.col("r"), 50, 3).first()
    assert got.observed == 1.0 and got.null_mean < 0.8 and got.p == pytest.approx(1 / 51)
    fixed = spark.createDataFrame([("g", f"c{i}", f"r{i}", 1.0, 1.0) for i in range(5)], df.schema)
    assert S.within_cluster_permutation(fixed, ["g"], "c", "row", F.col("l"), F.col("r"), 20, 3).first().p == 1.0


def test_correlation_permutation():
    x = np.arange(6.0)
    assert S.correlation_permutation(x, x, 500, 1) < 0.02 < 0.9 < S.correlation_permutation(x, -x, 500, 1)


def test_permutation_by_counts_against_brute_force(spark):
    clusters = {"a": [(1, 1), (1, -1), (-1, -1), (0, 0)], "b": [(1, 1), (-1, 0), (0, 1)]}
    rows = [("g", c, f"r{i}", float(x), float(y)) for c, v in clusters.items() for i, (x, y) in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, c string, row string, l double, r double")
    agree = lambda v, p: sum(x != 0 and x == y for (x, _), y in zip(v, p, strict=True))
    nulls = [agree(clusters["a"], p) + agree(clusters["b"], q) for p in itertools.permutations([y for _, y in clusters["a"]]) for q in itertools.permutations([y for _, y in clusters["b"]])]
    got = S.within_cluster_permutation_counts(df, ["g"], "c", F.col("l"), F.col("r"), 10_000, 7).first()
    assert got.observed == pytest.approx(3 / 5) and got.null_mean == pytest.approx(np.mean(nulls) / 5, abs=0.01)
    assert got.p == pytest.approx(np.mean([n >= 3 for n in nulls]), abs=0.02)
    sure = spark.createDataFrame([("g", f"c{i % 10}", "r", s, s) for i, s in enumerate([1.0, 1.0, -1.0] * 40)], df.schema)
    assert S.within_cluster_permutation_counts(sure, ["g"], "c", F.col("l"), F.col("r"), 10_000, 7).first().p == 1 / 10_001


def test_registered_sizes_are_those_of_the_reference(spark, monkeypatch):
    from tidewright.plans import queries_cells as Q

    monkeypatch.setattr(Q, "cells", lambda *_: spark.createDataFrame([], "model string, category string, patient string, item_text string, delta_physician double, delta_llm_correct double, delta_llm_shuffled double, alignment_difference double"))
    seen = []
    monkeypatch.setattr(Q.S, "bootstrap_metric", lambda *a: seen.append(a[4]))
    monkeypatch.setattr(Q.S, "within_cluster_permutation_counts", lambda *a: seen.append(a[5]))
    monkeypatch.setattr(Q.S, "bootstrap_means", lambda *a: seen.append(a[2]))
    Q.b1_bootstrap_metric(spark, "")
    Q.r2_within_cluster_permutation_10000(spark, "")
    Q.b1_bootstrap_hash_draws_1000(spark, "")
    assert seen == [1000, 10_000, 1000]
