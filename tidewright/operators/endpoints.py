"""Shift endpoints per model and category, with an ``aggregate`` row per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.cells import EPSILON
from tidewright.operators.resample import bootstrap_means, cluster_sums, sign_flip_sampled

AGGREGATE = "aggregate"


def strict_mean(column: Column) -> Column:
    """The mean, null as soon as one value is missing."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.avg(column))


def by_model_and_category(cells: DataFrame) -> DataFrame:
    """Each cell once for its category and once for the aggregate row.

    Two records a cell before a partial aggregation; the same as grouping sets.
    """
    return cells.withColumn("category", F.explode(F.array(F.col("category"), F.lit(AGGREGATE))))


def context_sensitivity(cells: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Mean absolute shift under the right and the shuffled context, their difference, counts and changed shares."""
    c, s = F.abs("delta_llm_correct"), F.abs("delta_llm_shuffled")
    return by_model_and_category(cells).groupBy("model", "category").agg(
        F.count_distinct("patient").alias("n_patients"), F.count_distinct("patient", "item_text").alias("n_patient_items"), F.count(F.lit(1)).alias("n_cells"),
        strict_mean(c).alias("mean_abs_delta_correct"), strict_mean(s).alias("mean_abs_delta_shuffled"), strict_mean(c - s).alias("mean_abs_delta_difference"),
        F.avg(F.coalesce(c > epsilon, F.lit(False)).cast("double")).alias("proportion_changed_correct"), F.avg(F.coalesce(s > epsilon, F.lit(False)).cast("double")).alias("proportion_changed_shuffled"),
    )


def directional_alignment(cells: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Alignment with the reference shift where that isn't zero; shifts below epsilon count as none, a missing one disagrees."""
    still = lambda d: F.when(F.abs(d) < epsilon, 0.0).otherwise(F.col(d))
    c, s, sign = still("delta_llm_correct"), still("delta_llm_shuffled"), F.signum("delta_physician")
    rate = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    return by_model_and_category(cells.where("delta_physician <> 0")).groupBy("model", "category").agg(
        F.count_distinct("patient").alias("n_patients"), F.count(F.lit(1)).alias("n_shift_cells"),
        strict_mean(sign * c).alias("mean_alignment_correct"), strict_mean(sign * s).alias("mean_alignment_shuffled"),
        rate(F.signum(c) == sign).alias("sign_agreement_correct"), rate(F.signum(s) == sign).alias("sign_agreement_shuffled"),
        rate(c == 0).alias("unchanged_rate_correct"), rate(s == 0).alias("unchanged_rate_shuffled"),
    )


def class_effects(cells: DataFrame) -> DataFrame:
    """Mean and mean absolute shifts of the reference and the model; missing shifts are left out."""
    both = [(f"{name}_{what}", f(col)) for col, what in (("delta_physician", "delta_physician"), ("delta_llm_correct", "delta_llm_correct"), ("delta_llm_shuffled", "delta_llm_shuffled")) for name, f in (("mean", F.avg), ("mean_abs", lambda c: F.avg(F.abs(c))))]
    return by_model_and_category(cells).groupBy("model", "category").agg(*(e.alias(n) for n, e in both))


def average_rank(column: str, *partition: str) -> Column:
    """Rank with ties at their mean."""
    same = F.count(F.lit(1)).over(W.partitionBy(*partition, column))
    return F.rank().over(W.partitionBy(*partition).orderBy(column)) + (same - 1) / 2


def class_correspondence(cells: DataFrame) -> DataFrame:
    """Per model the Pearson and Spearman correlation of class means; null below three categories."""
    means = class_effects(cells).where(F.col("category") != AGGREGATE).dropna(subset=["mean_delta_physician", "mean_delta_llm_correct", "mean_delta_llm_shuffled"])
    names = {"x": "mean_delta_physician", "c": "mean_delta_llm_correct", "s": "mean_delta_llm_shuffled"}
    ranked = means.withColumns({f"r{k}": average_rank(v, "model") for k, v in names.items()})
    corr = lambda a, b: F.when(F.count(F.lit(1)) >= 3, F.corr(a, b))
    out = ranked.groupBy("model").agg(
        corr(names["x"], names["c"]).alias("pearson_correct"), corr("rx", "rc").alias("spearman_correct"),
        corr(names["x"], names["s"]).alias("pearson_shuffled"), corr("rx", "rs").alias("spearman_shuffled"), F.count(F.lit(1)).alias("n_categories"),
    )
    return out.withColumns({f"{k}_correct_minus_shuffled": F.col(f"{k}_correct") - F.col(f"{k}_shuffled") for k in ("pearson", "spearman")})


def context_specificity(cells: DataFrame) -> DataFrame:
    """Mean alignment under the right and the shuffled context and their difference where the reference shifts."""
    return by_model_and_category(cells.where("delta_physician <> 0")).groupBy("model", "category").agg(
        F.count_distinct("patient").alias("n_patients"), F.count(F.lit(1)).alias("n_shift_cells"),
        strict_mean(F.col("alignment_correct")).alias("mean_alignment_correct"), strict_mean(F.col("alignment_shuffled")).alias("mean_alignment_shuffled"), strict_mean(F.col("alignment_difference")).alias("mean_alignment_difference"),
    )


#: Value of a cell for each resampled endpoint, and the cells that count.
RESAMPLED = {
    "context_sensitivity": ("abs(delta_llm_correct) - abs(delta_llm_shuffled)", "true"),
    "directional_alignment": ("signum(delta_physician) * if(abs(delta_llm_correct) < 0.01, 0D, delta_llm_correct)", "delta_physician <> 0"),
    "context_specificity": ("alignment_difference", "delta_physician <> 0"),
}


def endpoint_intervals(cells: DataFrame, endpoint: str, resamples: int = 1000, permutations: int = 10000, seed: int = 42) -> DataFrame:
    """(model, category, point, low, high, p): cluster bootstrap interval and sign-flip p of an endpoint, missing values left out."""
    value, where = RESAMPLED[endpoint]
    sums = cluster_sums(by_model_and_category(cells.where(where)), ["model", "category"], "patient", F.expr(value))
    ci = bootstrap_means(sums, ["model", "category"], resamples, seed)
    p = sign_flip_sampled(sums, ["model", "category"], permutations, seed).select("model", "category", "p")
    return ci.join(p, ["model", "category"], "left")


def interpretation_flag(sensitivity: Column, low: Column, difference: Column, epsilon: float = EPSILON) -> Column:
    """The first rule that holds names the model's behaviour."""
    return (
        F.when(sensitivity.isNull(), "failed_validation").when(sensitivity <= epsilon, "no_context_sensitivity").when(low.isNull() | difference.isNull(), "failed_validation")
        .when(low <= 0, "nonspecific_context_inflation").when(difference < 0.05, "modest_patient_specific_alignment").otherwise("strong_patient_specific_alignment")
    )


#: Columns of the cells that the endpoints read.
USED = ["model", "patient", "item_text", "category", "delta_physician", "delta_llm_correct", "delta_llm_shuffled", "alignment_correct", "alignment_shuffled", "alignment_difference"]


def endpoint_summary(cells: DataFrame, failed: DataFrame, resamples: int = 1000, seed: int = 42, epsilon: float = EPSILON) -> DataFrame:
    """One row per model: counts, aggregate endpoints, the share of failed rows and the flag.

    The cells are made once and kept, as each endpoint reads them.
    """
    cells = cells.select(*USED).persist()
    total = lambda df: df.where(F.col("category") == AGGREGATE)
    h1 = total(context_sensitivity(cells, epsilon)).select("model", "n_patients", "n_patient_items", "n_cells", "mean_abs_delta_correct", "mean_abs_delta_difference", "proportion_changed_correct")
    h2 = total(directional_alignment(cells, epsilon)).select("model", F.col("n_shift_cells").alias("n_physician_shift_cells"), F.col("mean_alignment_correct").alias("alignment"), "sign_agreement_correct")
    h3 = class_correspondence(cells).select("model", "pearson_correct", "spearman_correct")
    h4 = total(context_specificity(cells)).select("model", "mean_alignment_difference")
    sums = cluster_sums(cells.where("delta_physician <> 0"), ["model"], "patient", F.col("alignment_difference"))
    ci = bootstrap_means(sums, ["model"], resamples, seed).select("model", F.col("low").alias("specificity_low"), F.col("high").alias("specificity_high"))
    bad = failed.groupBy("model").agg(F.count(F.lit(1)).alias("n_failed"))
    joined = h1.join(h2, "model", "left").join(h3, "model", "left").join(h4, "model", "left").join(ci, "model", "left").join(bad, "model", "left").na.fill(0, ["n_failed"])
    rate = F.col("n_failed") / F.greatest(F.col("n_cells") + F.col("n_failed"), F.lit(1))
    return joined.withColumns({"failure_rate": rate, "flag": interpretation_flag(F.col("mean_abs_delta_correct"), F.col("specificity_low"), F.col("mean_alignment_difference"), epsilon)})


def behaviour_flags(cells: DataFrame, resamples: int = 1000, seed: int = 42, epsilon: float = EPSILON) -> DataFrame:
    """(model, flag) of ``endpoint_summary``, from a row per model and patient, which is all that is kept."""
    moved, shifts = F.abs("delta_llm_correct"), F.col("delta_physician") != 0
    gain = F.when(shifts, F.col("alignment_difference"))
    per = cells.groupBy("model", F.col("patient").alias("cluster")).agg(
        F.count(F.lit(1)).alias("cells"), F.count(moved).alias("known"), F.sum(moved).alias("moved"), F.count_if(shifts).alias("shifts"), F.sum(gain).alias("s"), F.count(gain).alias("n"),
    ).persist()
    mean = lambda total, n, whole: F.when(F.sum(n) == F.sum(whole), F.sum(total) / F.nullif(F.sum(n), F.lit(0)))
    points = per.groupBy("model").agg(mean("moved", "known", "cells").alias("sensitivity"), mean("s", "n", "shifts").alias("difference"))
    ci = bootstrap_means(per.where("n > 0").select("model", "cluster", "s", "n"), ["model"], resamples, seed).select("model", "low")
    return points.join(ci, "model", "left").select("model", interpretation_flag(F.col("sensitivity"), F.col("low"), F.col("difference"), epsilon).alias("flag"))


def model_ranking(summary: DataFrame, by: str = "mean_alignment_difference") -> DataFrame:
    """Models from the largest value on, missing ones last; ties by name."""
    return summary.select("model", by, F.row_number().over(W.orderBy(F.desc_nulls_last(by), "model")).alias("rank"))  # one row per model
