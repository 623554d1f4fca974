"""Frames over the test tables that several queries share, and their DuckDB definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import cells as C
from tidewright.operators import reference as R
from tidewright.sources.tables import CLASSES, study_ratings, table

KEYS = ["patient", "item"]


def sheet(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return study_ratings(spark, sf).where(F.col("sheet") == name)


def consensus(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return R.aggregate_observers(sheet(spark, sf, name), KEYS, "physician", CLASSES, "row_id")


def reference(spark: SparkSession, sf: str) -> DataFrame:
    labels = R.paired_labels(study_ratings(spark, sf), KEYS, "sheet", "test", "interview", "physician", CLASSES, "row_id")
    return labels.withColumnsRenamed({"patient": "patient_id", "item": "item_text"})


def pivoted(spark: SparkSession, sf: str) -> DataFrame:
    return C.pivoted_scores(table(spark, sf, "scores"), CLASSES)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells_of(spark, sf, wide_reference(spark, sf))


def wide_reference(spark: SparkSession, sf: str) -> DataFrame:
    labels = R.paired_wide_labels(study_ratings(spark, sf), KEYS, "sheet", "test", "interview", "physician", CLASSES, "row_id")
    return labels.withColumnsRenamed({"patient": "patient_id", "item": "item_text"})


def cells_of(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    return C.paired_wide_cells(C.wide_scores(table(spark, sf, "scores"), CLASSES), labels, CLASSES)


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Scores under the right context as predictions of the interview consensus."""
    return cells(spark, sf).select("model", "category", "patient", "item_text", F.col("physician_interview_consensus").alias("y"), F.col("llm_correct_context").alias("p")).dropna(subset=["y", "p"])


_C = ", ".join(CLASSES)
_AVG = ", ".join(f"avg({c}) as {c}" for c in CLASSES)

#: Common table expressions, each with the ones that it needs before it.
CTE = {
    "rv": f"rv as (select row_id, sheet, regexp_extract(patient, '([0-9]+)', 1) as patient, physician, regexp_replace(item, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as item, {_C}, rated_at, loaded_at from ratings)",
    "kept": f"""w as (select *, count(*) over (partition by sheet, patient, item) as n_, count(*) over (partition by sheet, patient, item, physician, {_C}) as copies_,
      row_number() over (partition by sheet, patient, item, physician, {_C} order by row_id) as rn_ from rv),
    u as (select *, sum(case when rn_ = 1 then 1 else 0 end) over (partition by sheet, patient, item) as uniq_, min(copies_) over (partition by sheet, patient, item) as least_ from w),
    kept as (select * from u where n_ = 2 or (least_ >= 2 and uniq_ = 2 and rn_ = 1) or patient is null or item is null)""",
    "cons": f"cons as (select sheet, patient, item, {_AVG}, list_sort(list(distinct physician) filter (where physician is not null)) as physician_ids from kept group by sheet, patient, item)",
    "ref": "ref as (" + " union all ".join(f"select a.patient as patient_id, a.item as item_text, '{c}' as category, a.{c} as survey, b.{c} as interview, b.{c} - a.{c} as delta from cons a join cons b on a.patient = b.patient and a.item = b.item where a.sheet = 'test' and b.sheet = 'interview'" for c in CLASSES) + ")",
    "piv": f"""one as (select * from (select *, row_number() over (partition by model, patient_id, item_text, score_condition order by score_id desc) as rn_ from scores) where rn_ = 1),
    wide as (select model, patient_id, item_text, {", ".join(f"max(case when score_condition = '{k}' then {c} end) as {c}__{k}" for c in CLASSES for k in ("context_free", "correct_context", "shuffled_context"))} from one group by model, patient_id, item_text),
    piv as ({" union all ".join(f"select model, patient_id, item_text, '{c}' as category, {c}__context_free as llm_context_free, {c}__correct_context as llm_correct_context, {c}__shuffled_context as llm_shuffled_context from wide" for c in CLASSES)})""",
    "cells": """cells0 as (select p.model, p.patient_id as patient, p.item_text, p.category, survey as physician_survey_consensus, interview as physician_interview_consensus, delta as delta_physician, llm_context_free, llm_correct_context, llm_shuffled_context,
      llm_correct_context - llm_context_free as delta_llm_correct, llm_shuffled_context - llm_context_free as delta_llm_shuffled from piv p join ref r on p.patient_id = r.patient_id and p.item_text = r.item_text and p.category = r.category),
    cells as (select *, sign(delta_physician) * delta_llm_correct as alignment_correct, sign(delta_physician) * delta_llm_shuffled as alignment_shuffled,
      sign(delta_physician) * delta_llm_correct - sign(delta_physician) * delta_llm_shuffled as alignment_difference, delta_physician <> 0 as physician_shift_indicator,
      coalesce(abs(delta_llm_correct) > 0.01, false) as llm_correct_changed_indicator, coalesce(abs(delta_llm_shuffled) > 0.01, false) as llm_shuffled_changed_indicator from cells0)""",
    "both": "both_ as (select * from cells union all select * replace ('aggregate' as category) from cells)",
    "preds": "preds as (select model, category, patient, item_text, physician_interview_consensus as y, llm_correct_context as p from cells where physician_interview_consensus is not null and llm_correct_context is not null)",
}
NEEDS = {"rv": [], "kept": ["rv"], "cons": ["kept"], "ref": ["cons"], "piv": [], "cells": ["piv", "ref"], "both": ["cells"], "preds": ["cells"]}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A statement with the named expressions and what they need before it; ``body`` may go on with ', more as (...)'."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS[name]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    head = ",\n".join(CTE[n] for n in order)
    return f"with {'recursive ' if recursive else ''}{head}\n{body}" if head else body
