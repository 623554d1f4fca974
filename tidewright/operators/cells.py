"""The paired cells: one row per model, patient, item and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.sources.tables import CONDITIONS

EPSILON = 0.01


def last_scores(scores: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last of several rows of one key, by ``order``."""
    ranked = scores.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order))))
    return ranked.where("__rn = 1").drop("__rn")


def _class_rows(classes: list[str], columns: dict[str, str]) -> Column:
    """A row per class: category, and of each struct of classes its value under the name given."""
    return F.inline(F.array(*(F.struct(F.lit(c).alias("category"), *(F.col(k)[c].alias(name) for k, name in columns.items())) for c in classes)))


def pivoted_scores(scores: DataFrame, classes: list[str], condition: str = "score_condition", order: str = "score_id") -> DataFrame:
    """(model, patient_id, item_text, category, llm_context_free, llm_correct_context, llm_shuffled_context).

    A key with any condition has a row (a full outer join of the conditions);
    of a repeated key the last score holds. One shuffle by key, then the classes
    are unpivoted.
    """
    wide = wide_scores(scores, classes, condition, order)
    return wide.select("model", "patient_id", "item_text", _class_rows(classes, {cond: f"llm_{cond}" for cond in CONDITIONS}))


def wide_scores(scores: DataFrame, classes: list[str], condition: str = "score_condition", order: str = "score_id") -> DataFrame:
    """``pivoted_scores`` before the classes are unpivoted: a struct of classes per condition."""
    one = last_scores(scores, ["model", "patient_id", "item_text", condition], order)
    picked = [F.max(F.when(F.col(condition) == cond, F.struct(*classes))).alias(cond) for cond in CONDITIONS]
    return one.where(F.col(condition).isin(CONDITIONS)).groupBy("model", "patient_id", "item_text").agg(*picked)


def paired_cells(scores: DataFrame, reference: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Scores of ``pivoted_scores`` joined to reference labels (patient_id, item_text, category, survey, interview, delta)."""
    return _shifts(scores.join(reference, ["patient_id", "item_text", "category"]), epsilon)


def paired_wide_cells(scores: DataFrame, reference: DataFrame, classes: list[str], epsilon: float = EPSILON) -> DataFrame:
    """``paired_cells`` of ``wide_scores`` and wide labels (patient_id, item_text, a, b): a key is joined once for all of its classes."""
    joined = scores.join(reference, ["patient_id", "item_text"])
    rows = _class_rows(classes, {cond: f"llm_{cond}" for cond in CONDITIONS} | {"a": "survey", "b": "interview"})
    return _shifts(joined.select("model", "patient_id", "item_text", rows).withColumn("delta", F.col("interview") - F.col("survey")), epsilon)


def _shifts(joined: DataFrame, epsilon: float) -> DataFrame:
    """The cells of scores beside their labels."""
    dc, ds, sign = F.col("delta_llm_correct"), F.col("delta_llm_shuffled"), F.signum("delta_physician")
    return (
        joined.withColumnsRenamed({"patient_id": "patient", "survey": "physician_survey_consensus", "interview": "physician_interview_consensus", "delta": "delta_physician"})
        .withColumns({"delta_llm_correct": F.col("llm_correct_context") - F.col("llm_context_free"), "delta_llm_shuffled": F.col("llm_shuffled_context") - F.col("llm_context_free")})
        .withColumns({"alignment_correct": sign * dc, "alignment_shuffled": sign * ds, "physician_shift_indicator": F.col("delta_physician") != 0})
        .withColumns({
            "alignment_difference": F.col("alignment_correct") - F.col("alignment_shuffled"),
            "llm_correct_changed_indicator": F.coalesce(F.abs(dc) > epsilon, F.lit(False)), "llm_shuffled_changed_indicator": F.coalesce(F.abs(ds) > epsilon, F.lit(False)),
        })
    )


def unmatched_scores(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """Score rows without a reference label."""
    return scores.join(reference, ["patient_id", "item_text", "category"], "left_anti")


def valid_pairs(pivoted: DataFrame, with_shuffled: bool = False) -> DataFrame:
    """(model, patient_id, item_text) whose scores are complete in both, or all three, conditions."""
    needed = [f"llm_{c}" for c in (CONDITIONS if with_shuffled else CONDITIONS[:2])]
    missing = F.count_if(F.expr(" or ".join(f"{c} is null" for c in needed)))
    return pivoted.groupBy("model", "patient_id", "item_text").agg(missing.alias("n_missing")).where("n_missing = 0").drop("n_missing")


def eligible_classes(reference: DataFrame, least: int = 15) -> DataFrame:
    """Non-zero reference deltas per category and whether they are enough."""
    per = reference.groupBy("category").agg(F.count_if(F.col("delta") != 0).alias("n_nonzero"), F.count("delta").alias("n_valid"))
    return per.withColumn("eligible", F.col("n_nonzero") >= least)
