"""Input checks of score tables, with the rows that fail them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.sources.tables import CONDITIONS, CONTEXT_FIELDS

KEYS = ["model", "patient_id", "item_text"]


def _bad_score(column: str) -> Column:
    return F.col(column).isNull() | F.isnan(column) | (F.col(column) < 0) | (F.col(column) > 1)


def failed_rows(scores: DataFrame, reference: DataFrame, classes: list[str], condition: str = "score_condition") -> DataFrame:
    """(model, patient_id, item_text, condition, reason): each row and reason once.

    Reasons: a score outside 0 to 1, a key that lacks a condition, a key that the
    reference lacks, a repeated key, a shuffled context of the same patient.
    """
    base = scores.withColumn("condition", F.col(condition))
    out = ["model", "patient_id", "item_text", "condition"]
    wrong = F.array_compact(F.array(*(F.when(_bad_score(c), F.lit(f"check3: {c}")) for c in classes)))
    own = F.when((F.col("condition") == "shuffled_context") & (F.col("context_patient_id") == F.col("patient_id")), F.lit("check8")) if "context_patient_id" in scores.columns else F.lit(None).cast("string")
    rowwise = base.select(*out, F.explode(F.concat(wrong, F.array_compact(F.array(own)))).alias("reason"))
    keys = base.where(F.col("condition").isin(CONDITIONS)).groupBy(*KEYS).agg(F.collect_set("condition").alias("have"))
    lacking = keys.where(F.size("have") < 3).select(*KEYS, F.lit(None).cast("string").alias("condition"), F.lit("check4").alias("reason"))
    unknown = base.join(reference.select("patient_id", "item_text").distinct(), ["patient_id", "item_text"], "left_anti").select(*out, F.lit("check5").alias("reason"))
    repeated = base.groupBy(*out).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*out, F.lit("check6").alias("reason"))
    return reduce(DataFrame.unionByName, [rowwise, lacking, unknown, repeated]).distinct()


def validation_summary(scores: DataFrame, reference: DataFrame, classes: list[str], condition: str = "score_condition", epsilon: float = 0.01) -> DataFrame:
    """(check_id, status, count) of eleven checks, each a small aggregation."""
    base = scores.withColumn("condition", F.col(condition))
    present = [c for c in classes if c in scores.columns]

    def check(number: int, counts: DataFrame, passed: Column, value: Column, otherwise: str = "FAIL") -> DataFrame:
        return counts.select(F.lit(number).alias("check_id"), F.when(passed, "PASS").otherwise(otherwise).alias("status"), value.cast("bigint").alias("count"))

    n = F.col("n")
    conditions = base.agg(F.count_distinct(F.when(F.col("condition").isin(CONDITIONS), F.col("condition"))).alias("n"))
    bad = base.agg(sum((F.count_if(_bad_score(c)) for c in present[1:]), F.count_if(_bad_score(present[0]))).alias("n"))
    keys = base.where(F.col("condition").isin(CONDITIONS)).groupBy(*KEYS).agg(F.count_distinct("condition").alias("c")).agg(F.count_if(F.col("c") < 3).alias("n"), F.count(F.lit(1)).alias("all"))
    mine = base.select("patient_id", "item_text").distinct().withColumn("s", F.lit(1))
    theirs = reference.select("patient_id", "item_text").distinct().withColumn("r", F.lit(1))
    both = mine.join(theirs, ["patient_id", "item_text"], "full").agg(F.count_if(F.col("s").isNull() | F.col("r").isNull()).alias("n"), F.count("r").alias("all"))
    repeated = base.groupBy(*KEYS, "condition").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n"))
    sizes = base.groupBy("model", "condition").agg(F.count(F.lit(1)).alias("c")).groupBy("model").agg(F.count_distinct("c").alias("d")).agg(F.count_if(F.col("d") > 1).alias("n"), F.count(F.lit(1)).alias("all"))
    shuffled = base.where(F.col("condition") == "shuffled_context").agg(F.count_if(F.col("context_patient_id") == F.col("patient_id")).alias("n"), F.count(F.lit(1)).alias("all")) if "context_patient_id" in scores.columns else None
    patients = base.agg(F.count_distinct("patient_id").alias("n"))
    first = lambda c: F.min_by(F.array(*present), F.when(F.col("condition") == c, F.col("score_id")))
    shifts = base.groupBy(*KEYS).agg(first("context_free").alias("a"), first("correct_context").alias("b")).where("a is not null and b is not null")
    moved = shifts.select(F.inline(F.arrays_zip("a", "b"))).agg(F.count_if(F.abs(F.col("b") - F.col("a")) > epsilon).alias("n"), F.count_if(F.abs(F.col("b") - F.col("a")) >= 1e-12).alias("any"))
    failed = failed_rows(scores, reference, classes, condition).agg(F.count(F.lit(1)).alias("n"))
    return reduce(DataFrame.unionByName, [
        check(1, conditions, n == 3, F.when(n == 3, n).otherwise(3 - n)),
        check(2, scores.sparkSession.range(1), F.lit(len(present) == len(classes)), F.lit(len(classes) if len(present) == len(classes) else len(classes) - len(present))),
        check(3, bad, n == 0, n), check(4, keys, n == 0, F.when(n == 0, F.col("all")).otherwise(n)), check(5, both, n == 0, F.when(n == 0, F.col("all")).otherwise(n)),
        check(6, repeated, n == 0, n), check(7, sizes, n == 0, F.when(n == 0, F.col("all")).otherwise(n)),
        check(8, shuffled, n == 0, F.when(n == 0, F.col("all")).otherwise(n)) if shuffled is not None else check(8, scores.sparkSession.range(1), F.lit(False), F.lit(0), "SKIP"),
        check(9, patients, n >= 2, n), check(10, moved, F.col("any") > 0, n, "WARN"), check(11, failed, n == 0, n, "INFO"),
    ])


def label_leakage(pairs: DataFrame, contexts: DataFrame, patient: str = "patient_id", item: str = "item_text") -> DataFrame:
    """(patient, item, field): the first context field, in their order, that holds the item's text, case aside.

    ``contexts`` has one row per patient and version with the fields as columns,
    texts or arrays of texts. Empty items are in no field.
    """
    kinds = dict(contexts.dtypes)
    joined = lambda c: F.lower(F.array_join(c, " ")) if kinds[c].startswith("array") else F.lower(F.col(c))
    fields = [c for c in CONTEXT_FIELDS if c in contexts.columns]
    texts = contexts.select(patient, F.posexplode(F.array(*map(joined, fields))).alias("i", "text"))
    needle = pairs.select(patient, item).where(F.col(item) != "").distinct()
    hits = needle.join(texts, patient).where(F.contains("text", F.lower(item)))
    return hits.groupBy(patient, item).agg(F.min("i").alias("i")).select(patient, item, F.array(*map(F.lit, fields))[F.col("i")].alias("field"))


def confident_rows(rows: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """Rows whose soft label is at least the threshold or at most one minus it."""
    return rows.where((F.col(label) >= threshold) | (F.col(label) <= 1 - threshold))


def stage_two_rows(rows: DataFrame, folds: DataFrame, fold: int, entity: str, labels: list[str]) -> DataFrame:
    """Rows of entities that the fold doesn't hold out and with a label."""
    known = F.coalesce(*(F.col(c) for c in labels)).isNotNull()
    return rows.join(folds.where(F.col("fold") == fold).select(entity), entity, "left_anti").where(known)
