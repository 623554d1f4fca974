import math

import pytest
from pyspark.sql import functions as F

from tidewright.operators import agreement as G
from tidewright.operators import metrics as M

SHROUT = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8]]


def test_icc(spark):
    rows = [("g", f"t{i}", f"r{j}", float(v)) for i, r in enumerate(SHROUT) for j, v in enumerate(r)] + [("flat", f"t{i}", f"r{j}", 1.0) for i in range(3) for j in range(2)] + [("one", "t", "r0", 1.0), ("one", "t", "r1", 0.0)]
    got = {r.g: r.icc for r in G.icc21(spark.createDataFrame(rows, "g string, t string, r string, v double"), ["g"], "t", "r", "v").collect()}
    assert got["g"] == pytest.approx(0.343, abs=0.005) and got["flat"] is None and got["one"] is None


def cells(spark, counts):
    """2x2 counts (a, b, c, d) of one stratum as cells."""
    rows = [(dp, dm) for n, dp, dm in zip(counts, (0.5, 0.5, -0.5, -0.5), (0.1, -0.1, 0.1, -0.1)) for _ in range(n)]
    return spark.createDataFrame([("m", "k", *r) for r in rows], "model string, category string, delta_physician double, delta_llm_correct double")


def test_mantel_haenszel(spark):
    assert G.mantel_haenszel(cells(spark, (8, 2, 5, 5)), "category", ["model"]).first().odds_ratio == pytest.approx(4.0)
    even = G.mantel_haenszel(cells(spark, (5, 5, 5, 5)), "category", ["model"]).first()
    assert even.odds_ratio == pytest.approx(1.0) and even.chi2 == pytest.approx(0.0) and G.chi2_tail(even.chi2) == 1.0
    assert G.mantel_haenszel(cells(spark, (5, 5, 0, 0)), "category", ["model"]).count() == 0


def test_entropy(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1.3,), (None,)], "p double")
    assert [r[0] for r in df.select(G.binary_entropy(F.col("p"))).collect()] == [0.0, 0.0, 1.0, 0.0, None]


def test_step_up(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "n string, p double")
    got = {r.n: r.p_adjusted for r in G.benjamini_hochberg(df, "p").collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.16 / 3, "b": 0.16 / 3, "d": 1.0})


def test_tails():
    assert G.binomial_tail(0, 10) == pytest.approx(1.0) and G.binomial_tail(10, 10) == pytest.approx(2**-10) and math.isnan(G.binomial_tail(0, 0))
    assert G.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6) and G.chi2_tail(3.841459) == pytest.approx(0.05, abs=1e-6)


def test_ranks(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", -1.0), ("g", 2.0), ("g", 0.0), ("g", 3.0)], "g string, d double")
    assert tuple(G.signed_rank(df, ["g"], "d").first()) == ("g", 4, 8.5)
    two = spark.createDataFrame([("g", 1.0, True), ("g", 2.0, True), ("g", 2.0, False), ("g", 3.0, False)], "g string, d double, f boolean")
    assert tuple(G.rank_sum(two, ["g"], "d", F.col("f")).first()) == ("g", 2, 2, 0.5)


def preds(spark, rows):
    return spark.createDataFrame([("g", float(y), float(p)) for y, p in rows], "g string, y double, p double")


def test_curves(spark):
    df = preds(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (0.5, 0.7)])
    pos, neg = 2.5, 2.5
    pairs = sum(a * (1 - b) * (1.0 if p > q else 0.5 if p == q else 0.0) for a, p in [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (0.5, 0.7)] for b, q in [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (0.5, 0.7)])
    assert M.roc_auc(df, ["g"]).first().auc == pytest.approx(pairs / (pos * neg))
    assert M.average_precision(df, ["g"]).first().ap == pytest.approx(0.4 * 1 + 0.6 * 2.5 / 4)
    assert M.roc_auc(preds(spark, [(1, 0.2), (1, 0.4)]), ["g"]).first().auc == 0.5
    assert M.average_precision(preds(spark, [(0, 0.2)]), ["g"]).first().ap == 0.0


def test_calibration(spark):
    df = preds(spark, [(1, 1.0), (0, 0.0), (1, 0.5), (0, 0.5), (1, 1.7)])
    assert M.expected_calibration_error(df, ["g"]).first().ece == pytest.approx(0.0)
    assert M.expected_calibration_error(preds(spark, [(1, 0.3), (0, 0.3)]), ["g"]).first().ece is None
    assert M.expected_calibration_error(preds(spark, [(1, 0.3)]), ["g"]).first().ece == pytest.approx(0.7)


def test_thresholds(spark):
    grid = M.threshold_grid(0.1, 0.9, 9)
    rows = [(1, 0.8), (1, 0.6), (0, 0.55), (0, 0.2), (0.5, 0.4)]
    got = M.tuned_thresholds(preds(spark, rows), ["g"], grid).first()

    def f1(t):
        tp, fp, fn = sum(y for y, p in rows if p >= t), sum(1 - y for y, p in rows if p >= t), sum(y for y, p in rows if p < t)
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    best = max(f1(t) for t in grid)
    assert got.score == pytest.approx(best) and got.threshold == min(t for t in grid if f1(t) > best - 1e-9)
    assert M.tuned_thresholds(preds(spark, rows), ["g"], grid, recall_floor=2.0).first().score == pytest.approx(best)


def test_isotonic(spark):
    assert {r.calibrated for r in M.isotonic(preds(spark, [(1, 0.2)] * 3)).collect()} == {1.0}
    rows = [(i > 10, i / 20) for i in range(20)]
    got = [r.calibrated for r in M.isotonic(preds(spark, rows)).orderBy("p").collect()]
    assert got == sorted(got) and got[0] == 0.0 and got[-1] == 1.0
    assert M.isotonic(preds(spark, [])).count() == 0


def test_running_sums(spark):
    import random

    from tidewright.plans.prefix import running_sums, value_ranks

    rng = random.Random(3)
    rows = [(g, x, rng.randrange(10)) for g in ("a", None, "b") for x in {round(rng.expovariate(1), 3) for _ in range(200)}] + [("one", 5.0, 2)]
    df = spark.createDataFrame(rows, "g string, x double, v int")
    for down in (False, True):
        got = {(r.g, r.x): (r.run_v, r.all_v, r.next_order) for r in running_sums(df, ["g"], "x", ["v"], down, 16).collect()}
        for g in ("a", None, "b", "one"):
            own = sorted(((x, v) for h, x, v in rows if h == g), reverse=down)
            total = 0
            for i, (x, v) in enumerate(own):
                total += v
                assert got[g, x] == (total, sum(v for _, v in own), own[i + 1][0] if i + 1 < len(own) else None)
    ties = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 2.0), ("g", None)], "g string, x double")
    assert {(r.x, r.rank) for r in value_ranks(ties, ["g"], "x").collect()} == {(1.0, 1.5), (2.0, 3.0)}
    assert running_sums(df.limit(0), ["g"], "x", ["v"]).count() == 0


def test_wasserstein(spark):
    df = spark.createDataFrame([("g", 0.1, 0.5), ("g", 0.9, 0.0), ("g", 0.4, 1.0), ("g", None, 1.0)], "g string, l double, r double")
    want = sum(abs(a - b) for a, b in zip(sorted([0.1, 0.9, 0.4]), sorted([0.5, 0.0, 1.0]))) / 3
    assert G.wasserstein(df, ["g"], "l", "r").first().w1 == pytest.approx(want)


def test_isotonic_query_calibrates_every_class(spark, monkeypatch):
    from tidewright.plans import queries_metrics as Q
    from tidewright.sources.tables import CLASSES

    rows = [("m", c, "1", f"i{k}", (k + j) % 2 * 1.0, 0.5) for j, c in enumerate(CLASSES) for k in range(3 + j % 2)]
    preds = spark.createDataFrame(rows, "model string, category string, patient string, item_text string, y double, p double")
    monkeypatch.setattr(Q, "preds", lambda *_: preds)
    got = {(r.category, r.item_text): r.calibrated for r in Q.ml_isotonic(spark, "").collect()}
    assert len(got) == len(rows) and {c for c, _ in got} == set(CLASSES)
    assert got[CLASSES[0], "i0"] == pytest.approx(1 / 3) and got[CLASSES[1], "i0"] == pytest.approx(1 / 2)
