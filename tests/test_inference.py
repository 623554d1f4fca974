import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import agreement as G
from tidewright.operators import features as E
from tidewright.operators import inference as I


def test_tails():
    for hits, n in ((0, 0), (3, 10), (10, 10), (0, 7), (61, 100)):
        exact = sum(math.comb(n, k) for k in range(hits, n + 1)) / 2**n
        assert abs(I.binomial_upper(hits, n) - exact) < 1e-12
    assert abs(I.binomial_upper(500_500, 1_000_000) - 0.1588) < 1e-3
    assert abs(I.beta_share(2, 3, 0.4) - 0.5248) < 1e-9


def cells(spark, seed=1, patients=12, rows=20):
    rng = random.Random(seed)
    out = []
    for p in range(patients):
        for i in range(rows):
            survey, interview = rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 0.5, 1.0])
            free = rng.random()
            context = min(1.0, max(0.0, free + 0.4 * (interview - survey) + rng.gauss(0, 0.4)))
            out.append((rng.choice(["m1", "m2"]), rng.choice(["a", "b"]), f"p{p}", f"i{i}", survey, interview, free, context, interview - survey, context - free))
    return spark.createDataFrame(out, "model string, category string, patient string, item_text string, physician_survey_consensus double, physician_interview_consensus double, llm_context_free double, llm_correct_context double, delta_physician double, delta_llm_correct double")


def test_joint_bootstrap(spark):
    df = spark.createDataFrame([(g, f"c{c}", float(v)) for g in "xy" for c in range(9) for v in range(c % 4)] + [("one", "c0", 3.0), ("null", "c0", None)], "g string, c string, v double")
    totals, draws = I.poisson_sums(df, ["g"], "c", {"s": F.col("v"), "n": F.lit(1.0)}, 200, 3)
    have = {r.g: (r.n_clusters, r.s, r.n) for r in totals.collect()}
    assert have["x"] == (6, 8.0, 12.0)
    assert have["null"] == (1, 0.0, 1.0)
    by = {(r.g, r.rep): (r.s, r.n) for r in draws.collect()}
    assert all(by["x", r] == by["y", r] for r in range(200))  # one draw of a cluster for all groups
    again = {(r.g, r.rep): (r.s, r.n) for r in I.poisson_sums(df.repartition(5), ["g"], "c", {"s": F.col("v"), "n": F.lit(1.0)}, 200, 3)[1].collect()}
    assert again == by
    row = I.macro_interval(df.where("g in ('x', 'y')").withColumn("k", F.lit(1)), ["k"], "g", "c", F.col("v"), F.lit(1.0), 200, 3).first()
    assert row.low < row.macro < row.high
    assert I.poisson_sums(df.limit(0), ["g"], "c", {"s": F.col("v")}, 10, 3)[0].count() == 0


def test_tables_hold_their_points(spark):
    whole = cells(spark).persist()
    keys = ["model", "category"]
    point = {(r.model, r.category): r.rate for r in G.sign_agreement(whole, keys).collect()}
    for r in I.sign_tests_resampled(whole, keys, ["model"], resamples=200, permutations=200).collect():
        assert r.rate == point[r.model, r.category] and r.low <= r.rate <= r.high and r.p <= r.p_adjusted <= 1 and 0 < r.p_permuted <= 1 and 0 < r.p_flipped <= 1
    for r in I.brier_tests(whole, keys, ["model"], resamples=200, permutations=200).collect():
        assert r.low <= r.improvement <= r.high and r.p <= r.p_adjusted + 1e-12
    for r in I.cmh_test(whole, "category", ["model"], resamples=200).collect():
        assert r.low <= r.odds_ratio <= r.high and abs(r.p - math.erfc(math.sqrt(r.chi2 / 2))) < 1e-12
    macro = I.macro_improvement(whole, I.brier_tests(whole, keys, ["model"], resamples=50, permutations=50), resamples=200).collect()
    assert len(macro) == 2 and all(r.low <= r.macro <= r.high and 0 <= r.n_significant <= 2 for r in macro)
    for r in I.wasserstein_interval(whole, keys, "llm_correct_context", "physician_interview_consensus", "patient", resamples=200).collect():
        assert r.low - 0.05 <= r.w1 <= r.high + 0.05
    marked = whole.withColumn("stratum", F.when(F.col("item_text") < "i3", "repeated").otherwise("novel"))
    for r in I.stratum_tests(marked, ["model"], resamples=200).collect():
        assert r.agreement_low <= r.agreement <= r.agreement_high and r.improvement_low <= r.improvement <= r.improvement_high
    whole.unpersist()


def test_architectures_and_calibration(spark):
    rows = cells(spark, 2).select("model", "category", "patient", F.col("physician_interview_consensus").alias("y"), F.col("llm_correct_context").alias("p"))
    out = {r.model: r for r in I.architecture_intervals(rows, "m1", resamples=200).collect()}
    assert out["m1"].brier_delta == out["m1"].brier_delta_low == out["m1"].brier_delta_high == 0
    data = rows.toPandas()
    want = data.assign(g=(data.p - data.y) ** 2).groupby(["model", "category"]).g.mean().groupby("model").mean()
    assert all(abs(out[m].brier - want[m]) < 1e-9 and out[m].brier_low <= out[m].brier <= out[m].brier_high for m in out)
    alone = rows.withColumn("patient", F.lit("p1"))
    for r in I.calibration_interval(rows, ["model"], "patient", resamples=200).collect():
        assert 0 <= r.low <= r.high <= 1 and r.ece >= 0
    assert all(r.low is None and r.high is None and r.ece is not None for r in I.calibration_interval(alone, ["model"], "patient", resamples=20).collect())


def test_mann_whitney(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 6, 30).astype(float), rng.integers(2, 8, 25).astype(float)
    df = spark.createDataFrame([("g", float(x), True) for x in a] + [("g", float(x), False) for x in b] + [("flat", 1.0, True), ("flat", 1.0, False), ("g", None, True)], "k string, v double, f boolean")
    got = {r.k: r for r in I.mann_whitney(df, ["k"], "v", F.col("f")).collect()}
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["g"].u == u and got["g"].p < 0.01 and got["flat"].p is None


def test_raters(spark):
    rng = random.Random(5)
    ratings = [(f"p{p}", f"i{i}", d, k, float(rng.random() < 0.5), float(rng.random() < 0.4)) for k, (p, i, d) in enumerate((p, i, d) for p in range(3) for i in range(6) for d in ("d1", "d2"))]
    ratings += [("p0", "i0", "d1", 1000, 1.0, 1.0), ("p9", None, "d1", 1001, 1.0, 1.0)]
    labels = I.individual_labels(spark.createDataFrame(ratings, "patient string, item string, physician string, row_id int, a double, b double"), ["patient", "item"], "physician", ["a", "b"], "row_id")
    held = {(r.patient, r.item, r.physician, r.category): r.label for r in labels.collect()}
    assert len(held) == 72 and held["p0", "i0", "d1", "a"] == 1
    preds = spark.createDataFrame([(f"p{p}", f"i{i}", c, rng.random()) for p in range(3) for i in range(6) for c in "ab"], "patient string, item string, category string, p double")
    p_of = {(r.patient, r.item, r.category): r.p for r in preds.collect()}
    got = I.rater_agreement(preds, labels).collect()
    assert len(got) == 6
    for r in got:
        x = np.array([[p_of[r.patient, i, c], v] for (p, i, d, c), v in held.items() if p == r.patient and d == r.physician])
        n = len(x)
        t, m, g = x.mean(1), x.mean(0), x.mean()
        ms_t, ms_r = 2 * ((t - g) ** 2).sum() / (n - 1), n * ((m - g) ** 2).sum()
        ms_e = ((x - t[:, None] - m + g) ** 2).sum() / (n - 1)
        assert r.n_items == 6 and abs(r.icc - (ms_t - ms_e) / (ms_t + ms_e + 2 * (ms_r - ms_e) / n)) < 1e-9
    humans = I.human_agreement(labels)
    assert humans.count() == 3
    row = I.rater_summary(I.rater_agreement(preds, labels), "model", resamples=100).first()
    assert row.n == 6 and row.icc_min <= row.icc_mean <= row.icc_max and row.low <= row.high


def test_weights(spark):
    got = spark.range(1).select(E.class_weight(F.lit(0.0), F.lit(100)).alias("a"), E.class_weight(F.lit(40.0), F.lit(100)).alias("b"), E.class_weight(F.lit(2.0), F.lit(100), "balanced").alias("c")).first()
    assert tuple(got) == (1.0, 1.0, 25.0)  # (1 - b) / (1 - b^m) is never above 1


def test_frames(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), ("y", 3)], "k string, n int")
    b = spark.createDataFrame([("x", 1), (None, 2), ("z", 9)], "k string, n int")
    assert tuple(I.alignment(a, b, ["k", "n"]).first()) == (2, 2, 1)
    assert tuple(I.alignment(a.limit(0), b.limit(0), ["k"]).first()) == (0, 0, 0)
    with pytest.raises(ValueError, match="1 keys are only in the first"):
        I.aligned(a.where("k = 'y'"), a.limit(0), ["k"])
    table = spark.createDataFrame([("Knee Pain ", 1), ("knee pain", 2), ("ÉX", 3), (None, 4)], "key string, v int")
    rows = spark.createDataFrame([(1, "KNEE pain"), (2, " knee pain "), (3, "other"), (4, None)], "id int, text string")
    assert {r.id: r.found for r in I.looked_up(rows, table, "text", "key", "v", "found").collect()} == {1: 1, 2: 1, 3: None, 4: None}
    got = {r.g: (r.n, r.m) for r in I.with_empty_rows(spark.createDataFrame([("a", 2, 0.5)], "g string, n int, m double"), spark.createDataFrame([("a",), ("b",)], "g string"), ["n"]).collect()}
    assert got == {"a": (2, 0.5), "b": (0, None)}
