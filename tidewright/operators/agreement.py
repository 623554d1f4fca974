"""Statistics of predictions and raters: sign agreement, effect sizes, entropy, agreement coefficients and corrections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.plans.prefix import running_sums


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def chi2_tail(x: float) -> float:
    """One degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def binomial_tail(hits: int, n: int, p: float = 0.5) -> float:
    """The chance of at least so many hits."""
    if n == 0:
        return float("nan")
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p) for k in range(hits, n + 1)]
    return min(1.0, sum(map(math.exp, log)))


def sign_agreement(cells: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, hits, rate): shared signs among non-zero reference deltas; no model shift disagrees."""
    hit = F.coalesce(F.signum("delta_llm_correct") == F.signum("delta_physician"), F.lit(False))
    return cells.where("delta_physician <> 0").groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("rate"))


def mantel_haenszel(cells: DataFrame, strata: str, groups: list[str]) -> DataFrame:
    """(groups, n_strata, odds_ratio, chi2, p): association of the signs over 2x2 strata.

    Rows: reference up or down; columns: model up, or not. A stratum without
    both directions or with an empty margin is left out. No continuity
    correction.
    """
    up, rise = F.col("delta_physician") > 0, F.coalesce(F.col("delta_llm_correct") > 0, F.lit(False))
    t = cells.where("delta_physician <> 0").groupBy(*groups, strata).agg(F.count_if(up & rise).alias("a"), F.count_if(up & ~rise).alias("b"), F.count_if(~up & rise).alias("c"), F.count_if(~up & ~rise).alias("d"))
    t = t.where("a + b > 0 and c + d > 0 and a + c > 0 and b + d > 0").withColumn("n", F.expr("cast(a + b + c + d as double)"))
    sums = t.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_strata"), F.sum(F.expr("a * d / n")).alias("num"), F.sum(F.expr("b * c / n")).alias("den"),
        F.sum(F.expr("a - (a + b) * (a + c) / n")).alias("dev"), F.sum(F.expr("(a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))")).alias("var"),
    )
    odds = F.when(F.col("den") > 0, F.col("num") / F.col("den"))
    return sums.select(*groups, "n_strata", odds.alias("odds_ratio"), F.when(F.col("var") > 0, F.col("dev") * F.col("dev") / F.col("var")).alias("chi2"))


def benjamini_hochberg(table: DataFrame, p: str, into: str = "p_adjusted", partition: list[str] = ()) -> DataFrame:
    """Step-up adjusted p values; a missing p counts as 1."""
    whole = W.partitionBy(*partition)
    filled = F.coalesce(F.col(p), F.lit(1.0))
    ranked = table.withColumns({"__p": filled, "__n": F.count(F.lit(1)).over(whole)}).withColumn("__r", F.row_number().over(whole.orderBy("__p")))
    down = whole.orderBy(F.desc("__p"), F.desc("__r")).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn(into, F.least(F.lit(1.0), F.min(F.col("__p") * F.col("__n") / F.col("__r")).over(down))).drop("__p", "__n", "__r")


def brier_improvement(cells: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, brier_free, brier_context, improvement): squared gap to the interview consensus without and with context."""
    gap = lambda c: (F.col(c) - F.col("physician_interview_consensus")) * (F.col(c) - F.col("physician_interview_consensus"))
    whole = cells.dropna(subset=["llm_context_free", "llm_correct_context", "physician_interview_consensus"])
    return whole.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(gap("llm_context_free")).alias("brier_free"), F.avg(gap("llm_correct_context")).alias("brier_context"), F.avg(gap("llm_context_free") - gap("llm_correct_context")).alias("improvement"))


def signed_rank(values: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, n, w_plus): Wilcoxon's rank sum of positive differences; zeros are left out, ties share their rank."""
    sided = values.where(f"{value} <> 0").select(*groups, F.abs(value).alias("__a"), (F.col(value) > 0).cast("int").alias("__up"))
    ups = sided.groupBy(*groups, "__a").agg(F.count(F.lit(1)).alias("__n"), F.sum("__up").alias("__u"))
    ranked = running_sums(ups, groups, "__a", ["__n"])
    rank = F.col("run___n") - F.col("__n") + (F.col("__n") + 1) / 2
    return ranked.groupBy(*groups).agg(F.sum("__n").alias("n"), F.sum(F.col("__u") * rank).alias("w_plus"))


def rank_sum(values: DataFrame, groups: list[str], value: str, first: Column) -> DataFrame:
    """(groups, n1, n2, u): Mann-Whitney U of the rows marked first against the others, ties half."""
    sided = values.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("__v"), first.cast("int").alias("__f"))
    counts = sided.groupBy(*groups, "__v").agg(F.count(F.lit(1)).alias("__n"), F.sum("__f").alias("__ones"))
    ranked = running_sums(counts, groups, "__v", ["__n"])
    rank = F.col("run___n") - F.col("__n") + (F.col("__n") + 1) / 2
    sums = ranked.groupBy(*groups).agg(F.sum("__ones").alias("n1"), F.sum(F.col("__n") - F.col("__ones")).alias("n2"), F.sum(F.col("__ones") * rank).alias("r1"))
    return sums.select(*groups, "n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"))


def wasserstein(values: DataFrame, groups: list[str], left: str, right: str) -> DataFrame:
    """(groups, w1): distance of the distributions of left and right, the area between their cumulated shares."""
    side = lambda c, m, n: F.struct(F.col(c).cast("double").alias("__x"), F.lit(m).alias("__m"), F.lit(n).alias("__l"))
    sides = F.array(side(left, 1, 1), side(right, -1, 0))
    masses = values.dropna(subset=[left, right]).select(*groups, F.inline(sides)).groupBy(*groups, "__x").agg(F.sum("__m").alias("__m"), F.sum("__l").alias("__l"))
    run = running_sums(masses, groups, "__x", ["__m", "__l"])
    step = F.coalesce(F.col("next_order") - F.col("__x"), F.lit(0.0))
    return run.groupBy(*groups).agg((F.sum(F.abs("run___m") * step) / F.max("all___l")).alias("w1"))


def binary_entropy(p: Column) -> Column:
    """Bits of a yes-no probability, clipped to 0 to 1; 0 at both ends."""
    p = F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    return F.when((p == 0) | (p == 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def entropy_changes(cells: DataFrame) -> DataFrame:
    """The cells with the entropy change of the reference and of the model."""
    e = lambda c: binary_entropy(F.col(c))
    return cells.withColumns({
        "entropy_change_reference": F.when(F.col("delta_physician").isNotNull(), e("physician_interview_consensus") - e("physician_survey_consensus")),
        "entropy_change_model": F.when(F.col("delta_llm_correct").isNotNull(), e("llm_correct_context") - e("llm_context_free")),
    })


def entropy_correlation(cells: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, n, r): Pearson correlation of both changes; null below three cells."""
    whole = entropy_changes(cells).dropna(subset=["entropy_change_reference", "entropy_change_model"])
    return whole.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, F.corr("entropy_change_reference", "entropy_change_model")).alias("r"))


def icc21(ratings: DataFrame, groups: list[str], target: str, rater: str, value: str) -> DataFrame:
    """(groups, n_targets, n_raters, icc): two-way random, absolute agreement, single rater.

    Targets that not all raters of the group rated are left out; null below two
    targets or raters.
    """
    own = ratings.where(F.col(value).isNotNull()).groupBy(*groups, target, rater).agg(F.avg(value).alias("v"))
    raters = own.groupBy(*groups).agg(F.count_distinct(rater).alias("k"))
    full = own.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*groups, target))).join(raters, groups).where("__n = k")
    g = W.partitionBy(*groups)
    m = full.withColumns({"__g": F.avg("v").over(g), "__t": F.avg("v").over(W.partitionBy(*groups, target)), "__r": F.avg("v").over(W.partitionBy(*groups, rater))})
    sq = lambda x: x * x
    s = m.groupBy(*groups).agg(
        F.count_distinct(target).alias("n"), F.max("k").alias("k"), F.sum(sq(F.col("__t") - F.col("__g"))).alias("ss_t"), F.sum(sq(F.col("__r") - F.col("__g"))).alias("ss_r"),
        F.sum(sq(F.col("v") - F.col("__t") - F.col("__r") + F.col("__g"))).alias("ss_e"),
    )
    ms_t, ms_r, ms_e = (F.expr(f"try_divide({a}, {b})") for a, b in (("ss_t", "n - 1"), ("ss_r", "k - 1"), ("ss_e", "(n - 1) * (k - 1)")))
    bottom = ms_t + (F.col("k") - 1) * ms_e + F.col("k") * (ms_r - ms_e) / F.col("n")
    return s.select(*groups, F.col("n").alias("n_targets"), F.col("k").alias("n_raters"), F.when((F.col("n") > 1) & (F.col("k") > 1) & (F.abs(bottom) >= 1e-12), (ms_t - ms_e) / bottom).alias("icc"))


def concordance(values: DataFrame, groups: list[str], left: str, right: str) -> DataFrame:
    """(groups, n, ccc): Lin's concordance with population moments; null when nothing varies and means agree."""
    whole = values.dropna(subset=[left, right])
    gap = F.avg(left) - F.avg(right)
    bottom = F.var_pop(left) + F.var_pop(right) + gap * gap
    return whole.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.when(bottom > 1e-12, 2 * F.covar_pop(left, right) / bottom).alias("ccc"))


def tau_check(thresholds: DataFrame, tau: float, tolerance: float = 0.05) -> DataFrame:
    """Tuned thresholds against tau: the gap and whether it is small."""
    gap = F.abs(F.col("threshold") - tau)
    return thresholds.withColumns({"gap": gap, "robust": gap <= tolerance + 1e-12})


def stratum_comparison(cells: DataFrame, known_items: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, stratum, n_items, n_cells, agreement, improvement) for items that occur in training (repeated) and others (novel)."""
    marked = cells.join(known_items.select(F.col("item").alias("item_text")).distinct().withColumn("__k", F.lit(True)), "item_text", "left")
    marked = marked.withColumn("stratum", F.when(F.col("__k"), "repeated").otherwise("novel"))
    hit = F.coalesce(F.signum("delta_llm_correct") == F.signum("delta_physician"), F.lit(False)).cast("double")
    gap = lambda c: (F.col(c) - F.col("physician_interview_consensus")) * (F.col(c) - F.col("physician_interview_consensus"))
    return marked.groupBy(*groups, "stratum").agg(
        F.count_distinct("item_text").alias("n_items"), F.count(F.lit(1)).alias("n_cells"), F.avg(F.when(F.col("delta_physician") != 0, hit)).alias("agreement"), F.avg(gap("llm_context_free") - gap("llm_correct_context")).alias("improvement")
    )


def ablation_effect(baseline: DataFrame, ablated: DataFrame, keys: list[str]) -> DataFrame:
    """(field, category, effect): mean absolute change of a prediction when a context field is left out."""
    both = ablated.join(baseline.select(*keys, "category", F.col("score").alias("__b")), [*keys, "category"])
    return both.groupBy("field", "category").agg(F.avg(F.abs(F.col("__b") - F.col("score"))).alias("effect"))
