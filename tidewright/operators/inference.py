"""Intervals and tests around the statistics: joint cluster bootstrap, tails of distributions, tables per class, rater and architecture.

The bootstrap draws each cluster a Poisson number of times, from a generator
seeded by the cluster's hash. All groups see the same draw of a cluster, so
means over classes and differences of models get intervals too. A task adds up
its own clusters; only arrays of one sum a draw are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators import agreement as G
from tidewright.operators import resample as S

#: The ends of an interval.
ENDS = (0.025, 0.975)


def sign_hit() -> Column:
    """1 where model and reference shift the same way, 0 where not; no model shift disagrees."""
    return F.coalesce(F.signum("delta_llm_correct") == F.signum("delta_physician"), F.lit(False)).cast("double")


# Tails --------------------------------------------------------------------------------------------


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def binomial_upper(hits: int, n: int, p: float = 0.5) -> float:
    """The chance of at least so many hits, for any n."""
    return 1.0 if hits <= 0 else beta_share(hits, n - hits + 1, p)


def _each(f, *columns: str) -> Column:
    """f of the columns of each row, null where one of them is; for tables of a row per group."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*series, strict=True)], dtype="float64")

    return run(*columns)


def binomial_p(hits: str, n: str) -> Column:
    return _each(lambda k, m: binomial_upper(int(k), int(m)), hits, n)


def two_sided_p(z: str) -> Column:
    return _each(lambda x: min(1.0, 2 * G.normal_tail(abs(x))), z)


def chi2_p(x: str) -> Column:
    return _each(G.chi2_tail, x)


# Joint cluster bootstrap --------------------------------------------------------------------------


def poisson_sums(df: DataFrame, groups: list[str], cluster: str, values: dict[str, Column], resamples: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(totals, draws): per group the sums of the values, the number of clusters, and the sums of each draw.

    totals: groups, n_clusters, values; draws: groups, rep, values. Nulls add 0.
    """
    names = list(values)
    kinds = dict(df.dtypes)
    per = df.groupBy(*groups, F.col(cluster).cast("string").alias("__c")).agg(*(F.coalesce(F.sum(v.cast("double")), F.lit(0.0)).alias(n) for n, v in values.items()))
    keyed = per.withColumn("__h", F.xxhash64(F.lit(seed), "__c")).drop("__c")
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "n_clusters bigint", *(f"`{n}` double, `__{n}` array<double>" for n in names)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            rows = pdf[names].to_numpy(float)
            for key, row, h in zip(pdf[groups].itertuples(index=False, name=None) if groups else [()] * len(pdf), rows, pdf["__h"], strict=True):
                times = np.random.default_rng(int(h) & 0xFFFFFFFFFFFFFFFF).poisson(1.0, resamples)
                acc = held.setdefault(key, [0, np.zeros(len(names)), np.zeros((len(names), resamples))])
                acc[0] += 1
                acc[1] += row
                acc[2] += row[:, None] * times
        for key, (n, total, draws) in held.items():
            yield pd.DataFrame({**dict(zip(groups, ([k] for k in key), strict=True)), "n_clusters": [n], **{c: v for i, name in enumerate(names) for c, v in ((name, [total[i]]), (f"__{name}", [draws[i]]))}})

    parts = keyed.mapInPandas(partial, schema)
    totals = parts.groupBy(*groups).agg(F.sum("n_clusters").alias("n_clusters"), *(F.sum(n).alias(n) for n in names))
    draws = parts.select(*groups, F.posexplode(F.arrays_zip(*(f"__{n}" for n in names))).alias("rep", "x")).groupBy(*groups, "rep").agg(*(F.sum(f"x.__{n}").alias(n) for n in names))
    return totals, draws


def interval(draws: DataFrame, groups: list[str], value: Column, low: str = "low", high: str = "high") -> DataFrame:
    """(groups, low, high): the percentile interval of a value over the draws, draws without value left out."""
    q = F.percentile(value, F.array(*map(F.lit, ENDS)))
    return draws.groupBy(*groups).agg(q.alias("__q")).select(*groups, F.get("__q", F.lit(0)).alias(low), F.get("__q", F.lit(1)).alias(high))


def _safe(a: str, b: str) -> Column:
    return F.expr(f"try_divide({a}, nullif({b}, 0))")


def _ends(table: DataFrame, several: Column) -> DataFrame:
    """No interval where there is but one cluster."""
    return table.withColumns({c: F.when(several, F.col(c)) for c in table.columns if c.endswith(("low", "high"))})


def macro_interval(df: DataFrame, keep: list[str], over: str, cluster: str, num: Column, den: Column, resamples: int, seed: int) -> DataFrame:
    """(keep, n_groups, n_clusters, macro, low, high): the mean over the groups of ``over`` of a ratio of sums."""
    totals, draws = poisson_sums(df, [*keep, over], cluster, {"num": num, "den": den}, resamples, seed)
    point = totals.groupBy(*keep).agg(F.count(F.lit(1)).alias("n_groups"), F.max("n_clusters").alias("n_clusters"), F.avg(_safe("num", "den")).alias("macro"))
    per = draws.groupBy(*keep, "rep").agg(F.avg(_safe("num", "den")).alias("m"))
    ci = interval(per, keep, F.col("m"))
    return _ends(point.join(ci, keep, "left") if keep else point.withColumns({c: ci.select(c).scalar() for c in ("low", "high")}), F.col("n_clusters") > 1)


# Tables of the analyses ---------------------------------------------------------------------------


def sign_tests(cells: DataFrame, groups: list[str], partition: list[str] = (), least: int = 1) -> DataFrame:
    """(groups, n, hits, rate, p, p_adjusted): exact one-sided binomial test of the sign agreement against chance.

    Groups of fewer than ``least`` cells aren't tested and count as p = 1 in the step-up correction.
    """
    table = G.sign_agreement(cells, groups).withColumn("p", F.when(F.col("n") >= least, binomial_p("hits", "n")))
    return G.benjamini_hochberg(table, "p", "p_adjusted", list(partition))


def sign_tests_resampled(cells: DataFrame, groups: list[str], partition: list[str], cluster: str = "patient", resamples: int = 1000, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """sign_tests with the cluster interval, the rate and p of permutations within clusters, and the p of cluster sign flips."""
    shifted = cells.where("delta_physician <> 0")
    totals, draws = poisson_sums(shifted, groups, cluster, {"num": sign_hit(), "den": F.lit(1.0)}, resamples, seed)
    ci = _ends(totals.select(*groups, "n_clusters").join(interval(draws, groups, _safe("num", "den")), groups, "left"), F.col("n_clusters") > 1)
    mixed = S.within_cluster_permutation_counts(cells, groups, cluster, F.signum("delta_physician"), F.coalesce(F.signum("delta_llm_correct"), F.lit(0.0)), permutations, seed)
    flips = S.sign_flip_sampled(S.cluster_sums(shifted, groups, cluster, sign_hit() - 0.5), groups, permutations, seed)
    out = sign_tests(cells, groups, partition).join(ci, groups, "left")
    return out.join(mixed.select(*groups, F.col("null_mean").alias("null_rate"), F.col("p").alias("p_permuted")), groups, "left").join(flips.select(*groups, F.col("p").alias("p_flipped")), groups, "left")


def cmh_test(cells: DataFrame, strata: str, groups: list[str], cluster: str = "patient", resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(groups, n_strata, odds_ratio, chi2, p, low, high): the common odds ratio over strata with its test and cluster interval.

    Draws reweight the clusters' counts of each stratum; a draw without a usable stratum is left out.
    """
    up, rise = F.col("delta_physician") > 0, F.coalesce(F.col("delta_llm_correct") > 0, F.lit(False))
    one = lambda c: c.cast("double")
    _, draws = poisson_sums(cells.where("delta_physician <> 0"), [*groups, strata], cluster, {"a": one(up & rise), "b": one(up & ~rise), "c": one(~up & rise), "d": one(~up & ~rise)}, resamples, seed)
    usable = draws.where("a + b > 0 and c + d > 0 and a + c > 0 and b + d > 0").withColumn("n", F.expr("a + b + c + d"))
    odds = usable.groupBy(*groups, "rep").agg(F.sum(F.expr("a * d / n")).alias("num"), F.sum(F.expr("b * c / n")).alias("den"))
    ci = interval(odds, groups, _safe("num", "den"))
    return G.mantel_haenszel(cells, strata, groups).withColumn("p", chi2_p("chi2")).join(ci, groups, "left")


def brier_tests(cells: DataFrame, groups: list[str], partition: list[str], cluster: str = "patient", resamples: int = 1000, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """brier_improvement with cluster interval, sign-flip p and its step-up correction over all groups of the partition."""
    gain = F.expr("power(llm_context_free - physician_interview_consensus, 2) - power(llm_correct_context - physician_interview_consensus, 2)")
    whole = cells.dropna(subset=["llm_context_free", "llm_correct_context", "physician_interview_consensus"])
    totals, draws = poisson_sums(whole, groups, cluster, {"num": gain, "den": F.lit(1.0)}, resamples, seed)
    ci = _ends(totals.select(*groups, "n_clusters").join(interval(draws, groups, _safe("num", "den")), groups, "left"), F.col("n_clusters") > 1)
    flips = S.sign_flip_sampled(S.cluster_sums(whole, groups, cluster, gain), groups, permutations, seed).select(*groups, "p")
    return G.benjamini_hochberg(G.brier_improvement(cells, groups).join(ci, groups).join(flips, groups, "left"), "p", "p_adjusted", partition)


def macro_improvement(cells: DataFrame, tests: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Per model: the mean Brier improvement over classes with its interval, and the number of significant classes of ``tests``."""
    gain = F.expr("power(llm_context_free - physician_interview_consensus, 2) - power(llm_correct_context - physician_interview_consensus, 2)")
    whole = cells.dropna(subset=["llm_context_free", "llm_correct_context", "physician_interview_consensus"])
    macro = macro_interval(whole, ["model"], "category", "patient", gain, F.lit(1.0), resamples, seed)
    return macro.join(tests.groupBy("model").agg(F.count_if(F.col("p_adjusted") < 0.05).alias("n_significant")), "model", "left")


def wasserstein_interval(values: DataFrame, groups: list[str], left: str, right: str, cluster: str, resamples: int = 1000, seed: int = 42, bins: int = 1000) -> DataFrame:
    """(groups, w1, low, high): the distance of two distributions, its interval from values on a grid of 1/bins from 0 to 1.

    The point is exact; a draw's distance is off by at most 1/bins.
    """
    both = values.dropna(subset=[left, right])
    at = lambda c: F.floor(F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0)) * bins).cast("int")
    sides = F.array(F.struct(at(left).alias("bin"), F.lit(1.0).alias("m"), F.lit(1.0).alias("l")), F.struct(at(right).alias("bin"), F.lit(-1.0).alias("m"), F.lit(0.0).alias("l")))
    _, draws = poisson_sums(both.select(*groups, cluster, F.inline(sides)), [*groups, "bin"], cluster, {"m": F.col("m"), "l": F.col("l")}, resamples, seed)
    # at most bins + 1 rows a group and draw
    along = W.partitionBy(*groups, "rep").orderBy("bin")
    run = draws.withColumns({"c": F.sum("m").over(along), "step": F.lead("bin").over(along) - F.col("bin")})
    per = run.groupBy(*groups, "rep").agg((F.sum(F.abs("c") * F.coalesce("step", F.lit(0))) / bins).alias("area"), F.sum("l").alias("n"))
    return G.wasserstein(both, groups, left, right).join(interval(per, groups, _safe("area", "n")), groups, "left")


def mann_whitney(values: DataFrame, groups: list[str], value: str, first: Column) -> DataFrame:
    """(groups, n1, n2, u, p): two-sided normal approximation with ties and continuity correction; p null when nothing varies."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).cast("double").alias("t"))
    ties = counts.groupBy(*groups).agg(F.sum(F.expr("t * t * t - t")).alias("ties"))
    u = G.rank_sum(values, groups, value, first).join(ties, groups)
    n = F.col("n1") + F.col("n2")
    spread = F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * F.greatest(n - 1, F.lit(1))))
    z = F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5, F.lit(0.0)) / F.sqrt(spread)
    return u.withColumn("z", F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (spread > 0), z)).withColumn("p", two_sided_p("z")).select(*groups, "n1", "n2", "u", "p")


def stratum_tests(marked: DataFrame, groups: list[str], stratum: str = "stratum", cluster: str = "patient", resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(groups, stratum, agreement, improvement) with cluster intervals of both."""
    keys = [*groups, stratum]
    shift = F.coalesce(F.col("delta_physician") != 0, F.lit(False))
    gain = F.expr("power(llm_context_free - physician_interview_consensus, 2) - power(llm_correct_context - physician_interview_consensus, 2)")
    values = {"hits": F.when(shift, sign_hit()), "shifted": shift.cast("double"), "gain": gain, "n": gain.isNotNull().cast("double")}
    totals, draws = poisson_sums(marked, keys, cluster, values, resamples, seed)
    point = totals.select(*keys, "n_clusters", _safe("hits", "shifted").alias("agreement"), _safe("gain", "n").alias("improvement"))
    a = interval(draws, keys, _safe("hits", "shifted"), "agreement_low", "agreement_high")
    b = interval(draws, keys, _safe("gain", "n"), "improvement_low", "improvement_high")
    return _ends(point.join(a, keys, "left").join(b, keys, "left"), F.col("n_clusters") > 1)


def _architecture_values(threshold: float) -> dict[str, Column]:
    hit = (F.col("p") >= threshold).cast("double")
    return {"gap": (F.col("p") - F.col("y")) * (F.col("p") - F.col("y")), "n": F.lit(1.0), "tp": hit * F.col("y"), "fp": hit * (1 - F.col("y")), "fn": (1 - hit) * F.col("y")}


def _macro_scores(sums: DataFrame, keys: list[str]) -> DataFrame:
    f1 = F.coalesce(F.expr("try_divide(2 * tp, nullif(2 * tp + fp + fn, 0))"), F.lit(0.0))
    return sums.groupBy(*keys).agg(F.avg(_safe("gap", "n")).alias("brier"), F.avg(f1).alias("f1"))


def architectures(preds: DataFrame, reference: str, model: str = "model", threshold: float = 0.5) -> DataFrame:
    """(model, brier, f1, brier_delta, f1_delta): means over classes, and the difference to the reference model."""
    sums = preds.groupBy(model, "category").agg(*(F.sum(v).alias(n) for n, v in _architecture_values(threshold).items()))
    return _against(_macro_scores(sums, [model]), reference, model, [])


def _against(scores: DataFrame, reference: str, model: str, keys: list[str]) -> DataFrame:
    own = scores.where(F.col(model) == reference)
    if keys:
        scores = scores.join(own.select(*keys, F.col("brier").alias("__b"), F.col("f1").alias("__f")), keys)
    else:
        scores = scores.withColumns({"__b": own.select("brier").scalar(), "__f": own.select("f1").scalar()})
    return scores.withColumns({"brier_delta": F.col("brier") - F.col("__b"), "f1_delta": F.col("f1") - F.col("__f")}).drop("__b", "__f")


def architecture_intervals(preds: DataFrame, reference: str, cluster: str = "patient", model: str = "model", threshold: float = 0.5, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """architectures with intervals; the differences are paired, as all models see the same draw of a cluster."""
    _, draws = poisson_sums(preds, [model, "category"], cluster, _architecture_values(threshold), resamples, seed)
    per = _against(_macro_scores(draws, [model, "rep"]), reference, model, ["rep"])
    out = architectures(preds, reference, model, threshold)
    for value in ("brier", "f1", "brier_delta", "f1_delta"):
        out = out.join(interval(per, [model], F.col(value), f"{value}_low", f"{value}_high"), model, "left")
    return out


def calibration_interval(preds: DataFrame, groups: list[str], cluster: str, bins: int = 15, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(groups, n_clusters, ece, low, high): expected calibration error with its cluster interval; one cluster gives a point alone.

    Scores outside 0 to 1 are left out; a missing cluster is an error of the data and gives a null one.
    """
    inside = preds.where("p between 0 and 1").withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    totals, draws = poisson_sums(inside, [*groups, "bin"], cluster, {"gap": F.col("p") - F.col("y"), "n": F.lit(1.0)}, resamples, seed)
    ece = F.expr("try_divide(sum(abs(gap)), nullif(sum(n), 0))")
    per = draws.groupBy(*groups, "rep").agg(ece.alias("e"))
    clusters = inside.groupBy(*groups).agg(F.count_distinct(cluster).alias("n_clusters"))
    return _ends(clusters.join(totals.groupBy(*groups).agg(ece.alias("ece")), groups).join(interval(per, groups, F.col("e")), groups, "left"), F.col("n_clusters") > 1)


# Raters -------------------------------------------------------------------------------------------


def individual_labels(ratings: DataFrame, keys: list[str], rater: str, classes: list[str], order: str) -> DataFrame:
    """(keys, rater, category, label): each rater's own labels as whole numbers, the last row of an item holding."""
    named = ratings.dropna(subset=[*keys, rater])
    last = named.groupBy(*keys, rater).agg(F.max_by(F.struct(*classes), order).alias("s")).select(*keys, rater, *(F.col(f"s.{c}").cast("double").alias(c) for c in classes))
    return last.unpivot([*keys, rater], classes, "category", "label").where("label is not null").withColumn("label", F.col("label").cast("int"))


def rater_agreement(preds: DataFrame, labels: DataFrame, rater: str = "physician", least: int = 2) -> DataFrame:
    """(patient, rater, n_items, icc, ccc): the model as one more rater against each rater of a patient.

    preds: patient, item, category, p; labels: patient, item, category, rater,
    label. Items of a patient and classes are the targets; a rater with fewer
    than ``least`` items in common is left out.
    """
    keys = ["patient", rater]
    both = labels.join(preds, ["patient", "item", "category"]).where("p is not null")
    several = both.groupBy(*keys).agg(F.count_distinct("item").alias("n_items")).where(F.col("n_items") >= least)
    both = both.join(several, keys).withColumn("target", F.concat_ws("|", "category", "item"))
    two = both.select(*keys, "target", F.inline(F.array(F.struct(F.lit("model").alias("by"), F.col("p").alias("v")), F.struct(F.lit("human").alias("by"), F.col("label").cast("double").alias("v")))))
    icc = G.icc21(two, keys, "target", "by", "v").select(*keys, "icc")
    ccc = G.concordance(both.withColumn("y", F.col("label").cast("double")), keys, "p", "y").select(*keys, "ccc")
    return several.join(icc, keys).join(ccc, keys)


def human_agreement(labels: DataFrame, rater: str = "physician", least: int = 2) -> DataFrame:
    """(patient, n_items, icc, ccc) of a patient's first two raters, by name."""
    order = W.partitionBy("patient").orderBy(rater)
    first = labels.select("patient", rater).distinct().withColumn("k", F.row_number().over(order)).where("k <= 2")  # a row per rater
    sided = labels.join(first, ["patient", rater])
    pick = lambda k, name: sided.where(F.col("k") == k).select("patient", "item", "category", F.col("label").cast("double").alias(name))
    both = pick(1, "a").join(pick(2, "b"), ["patient", "item", "category"])
    several = both.groupBy("patient").agg(F.count_distinct("item").alias("n_items")).where(F.col("n_items") >= least)
    both = both.join(several, "patient").withColumn("target", F.concat_ws("|", "category", "item"))
    two = both.select("patient", "target", F.inline(F.array(F.struct(F.lit("1").alias("by"), F.col("a").alias("v")), F.struct(F.lit("2").alias("by"), F.col("b").alias("v")))))
    return several.join(G.icc21(two, ["patient"], "target", "by", "v").select("patient", "icc"), "patient").join(G.concordance(both, ["patient"], "a", "b").select("patient", "ccc"), "patient")


def rater_summary(table: DataFrame, kind: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """One row (kind, n, icc_mean, icc_sd, icc_min, icc_max, ccc_mean, low, high): the interval is that of the mean over patients drawn."""
    stats = table.agg(F.count("icc").alias("n"), F.avg("icc").alias("icc_mean"), F.stddev_samp("icc").alias("icc_sd"), F.min("icc").alias("icc_min"), F.max("icc").alias("icc_max"), F.avg("ccc").alias("ccc_mean"))
    _, draws = poisson_sums(table.where("icc is not null").withColumn("kind", F.lit(kind)), ["kind"], "patient", {"s": F.col("icc"), "n": F.lit(1.0)}, resamples, seed)
    ci = interval(draws, ["kind"], _safe("s", "n"))
    return stats.withColumn("kind", F.lit(kind)).join(ci, "kind", "left")


# Frames -------------------------------------------------------------------------------------------


def alignment(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n_both, n_left_only, n_right_only): how the keys of two frames agree, repeated keys by their number."""
    side = lambda df, n: df.groupBy(*(F.col(k).alias(f"__{n}_{k}") for k in keys)).agg(F.count(F.lit(1)).alias(n))
    a, b = side(left, "l"), side(right, "r")
    cond = [a[f"__l_{k}"].eqNullSafe(b[f"__r_{k}"]) for k in keys]
    n = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, cond, "full").agg(F.coalesce(F.sum(F.least(n("l"), n("r"))), F.lit(0)).alias("n_both"), F.coalesce(F.sum(F.greatest(n("l") - n("r"), F.lit(0))), F.lit(0)).alias("n_left_only"), F.coalesce(F.sum(F.greatest(n("r") - n("l"), F.lit(0))), F.lit(0)).alias("n_right_only"))


def aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both frames joined on keys that must agree one to one; an error names the numbers that don't."""
    both, only_left, only_right = alignment(left, right, keys).first()
    if only_left or only_right:
        raise ValueError(f"{only_left} keys are only in the first frame, {only_right} only in the second, {both} in both")
    return left.join(right, keys)


def looked_up(rows: DataFrame, table: DataFrame, text: str, key: str, value: str, into: str) -> DataFrame:
    """All columns of the rows and the value of the trimmed text in lower case, else of the text as it is; null when neither is there.

    The smallest value holds for a key that is listed several times.
    """
    one = lambda name, k: table.where(F.col(key).isNotNull()).groupBy(k.alias(f"__{name}")).agg(F.min(value).alias(f"__v_{name}"))
    folded, plain = one("folded", F.lower(F.trim(key))), one("plain", F.col(key))
    out = rows.join(folded, F.lower(F.trim(F.col(text))) == folded["__folded"], "left").join(plain, F.col(text) == plain["__plain"], "left")
    return out.withColumn(into, F.coalesce("__v_folded", "__v_plain")).drop("__folded", "__v_folded", "__plain", "__v_plain")


def with_empty_rows(table: DataFrame, groups: DataFrame, counts: list[str]) -> DataFrame:
    """A row for every group, counts 0 and all else null where the table has none."""
    keys = groups.columns
    return groups.join(table, keys, "left").na.fill(0, counts)
