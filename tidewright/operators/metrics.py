"""Soft-label classification metrics, calibration and thresholds.

Predictions are rows (groups..., label y in [0, 1], score p). A soft label gives
its mass to the positive side and the rest to the negative side. Curves work on
distinct scores: rows are first added up per score, then cumulated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.plans.prefix import running_sums


def confusion(preds: DataFrame, groups: list[str], threshold: float | Column = 0.5) -> DataFrame:
    """(groups, tp, fp, fn, tn): sums of soft labels on both sides of the threshold."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    hit = (F.col("p") >= threshold).cast("double")
    return preds.groupBy(*groups).agg(F.sum(F.col("y") * hit).alias("tp"), F.sum((1 - F.col("y")) * hit).alias("fp"), F.sum(F.col("y") * (1 - hit)).alias("fn"), F.sum((1 - F.col("y")) * (1 - hit)).alias("tn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def precision_recall(counts: DataFrame, beta: float = 0.5) -> DataFrame:
    """Precision, recall, F1, F-beta and MCC of a confusion table; division by zero gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    root = F.sqrt(F.greatest((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn), F.lit(1e-8)))
    return counts.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "f_beta": ratio((1 + beta**2) * p * r, beta**2 * p + r), "mcc": (tp * tn - fp * fn) / root, "youden": r + ratio(tn, tn + fp) - 1})


def _cumulated(preds: DataFrame, groups: list[str]) -> DataFrame:
    """Per distinct score, from the largest on: mass at it (pos, neg), down to it (tp, fp) and in all."""
    at = preds.groupBy(*groups, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return running_sums(at, groups, "p", ["pos", "neg"], descending=True).withColumnsRenamed({"run_pos": "tp", "run_neg": "fp"})


def pr_curve(preds: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, p, precision, recall) at each distinct score."""
    c = _cumulated(preds, groups)
    return c.select(*groups, "p", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("all_pos")).alias("recall"))


def average_precision(preds: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ap, auc_pr): step-wise average precision and the area by trapezoids from (0, 1); without positives 0."""
    c = _cumulated(preds, groups)
    before = F.col("tp") - F.col("pos") + F.col("fp") - F.col("neg")
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    last = F.when(before > 1e-12, (F.col("tp") - F.col("pos")) / before).otherwise(1.0)
    gain = ratio(F.col("pos"), F.col("all_pos"))
    return c.groupBy(*groups).agg(F.sum(gain * precision).alias("ap"), F.sum(gain * (precision + last) / 2).alias("auc_pr"))


def roc_auc(preds: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, auc): the chance that a positive ranks above a negative, ties half; one-sided labels give 1/2."""
    c = _cumulated(preds, groups)
    area = F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2))
    return c.groupBy(*groups).agg(F.when((F.max("all_pos") > 0) & (F.max("all_neg") > 0), area / (F.max("all_pos") * F.max("all_neg"))).otherwise(0.5).alias("auc"))


def roc_curve(preds: DataFrame, groups: list[str]) -> DataFrame:
    c = _cumulated(preds, groups)
    return c.select(*groups, "p", ratio(F.col("fp"), F.col("all_neg")).alias("fpr"), ratio(F.col("tp"), F.col("all_pos")).alias("tpr"))


def calibration_bins(preds: DataFrame, groups: list[str], bins: int = 15) -> DataFrame:
    """(groups, bin, n, mean_p, mean_y) over bins of equal width; scores outside 0 to 1 are left out."""
    inside = preds.where("p between 0 and 1")
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*groups, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def expected_calibration_error(preds: DataFrame, groups: list[str], bins: int = 15, constant_is_null: bool = True) -> DataFrame:
    """(groups, ece): mean gap of score and label over bins, by rows; null for constant scores of several rows."""
    per = calibration_bins(preds, groups, bins)
    ece = per.groupBy(*groups).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))
    if not constant_is_null:
        return ece
    flat = preds.groupBy(*groups).agg(((F.min("p") == F.max("p")) & (F.count(F.lit(1)) > 1)).alias("flat"))
    return ece.join(flat, groups).select(*groups, F.when(~F.col("flat"), F.col("ece")).alias("ece"))


def brier(preds: DataFrame, groups: list[str]) -> DataFrame:
    return preds.groupBy(*groups).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))


def macro(table: DataFrame, over: str, values: list[str], keep: list[str] = ()) -> DataFrame:
    """The mean of values over the groups of one column."""
    return table.groupBy(*keep).agg(F.count(over).alias("n_groups"), *(F.avg(v).alias(f"macro_{v}") for v in values))


def metrics_table(preds: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """Per class, their mean (Macro Average) and from pooled counts (Micro Aggregate), rounded to 4 places."""
    values = ["precision", "recall", "f1", "mcc", "prevalence", "predicted_rate"]
    counts = confusion(preds, [group], threshold)
    pooled = counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))).withColumn(group, F.lit("Micro Aggregate"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    rated = precision_recall(counts.unionByName(pooled)).withColumns({"prevalence": (F.col("tp") + F.col("fn")) / n, "predicted_rate": (F.col("tp") + F.col("fp")) / n})
    mean = rated.where(F.col(group) != "Micro Aggregate").agg(*(F.avg(v).alias(v) for v in values)).withColumn(group, F.lit("Macro Average"))
    return rated.select(group, *values).unionByName(mean).select(group, *(F.round(v, 4).alias(v) for v in values))


def threshold_grid(low: float, high: float, points: int) -> list[float]:
    """Distinct thresholds from low to high, inside 0 to 1."""
    step = (high - low) / max(points - 1, 1)
    return sorted({min(1.0, max(0.0, round(low + i * step, 10))) for i in range(points)})


def tuned_thresholds(preds: DataFrame, groups: list[str], grid: list[float], score: str = "f1", precision_floor: float = 0.0, recall_floor: float = 0.0) -> DataFrame:
    """(groups, threshold, score): the smallest threshold of the best score.

    Thresholds below a floor don't count; when none is left the floors are
    ignored. Rows are added up between thresholds first and then cumulated, so
    the grid isn't crossed with the rows.
    """
    edges = F.array(*map(F.lit, grid))
    at = F.aggregate(edges, F.lit(0), lambda n, t: n + (F.col("p") >= t).cast("int"))  # thresholds reached
    sums = preds.groupBy(*groups, at.alias("reached")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    per = sums.groupBy(*groups).agg(F.collect_list(F.struct("reached", "pos", "neg")).alias("b"))  # one per threshold
    rows = per.select(*groups, "b", F.posexplode(edges).alias("i", "threshold"))
    total = lambda field, cond: F.aggregate(F.filter("b", cond), F.lit(0.0), lambda a, x: a + x[field])
    above, below = (lambda x: x["reached"] > F.col("i")), (lambda x: x["reached"] <= F.col("i"))
    table = precision_recall(rows.select(*groups, "threshold", total("pos", above).alias("tp"), total("neg", above).alias("fp"), total("pos", below).alias("fn"), total("neg", below).alias("tn")))
    fits = (F.col("precision") >= precision_floor) & (F.col("recall") >= recall_floor)
    ranked = table.withColumn("rn", F.row_number().over(W.partitionBy(*groups).orderBy(F.desc(fits), F.desc(F.round(score, 12)), "threshold")))
    return ranked.where("rn = 1").select(*groups, "threshold", F.col(score).alias("score"))


def resolve_threshold(mode: str, tau: float = 0.5, fixed_f1: float = 0.5, tuned: Column | None = None) -> Column:
    """The threshold of a mode: tau, fixed_f1 or tuned; 0.5 when it has none."""
    return F.coalesce({"tau": F.lit(tau), "fixed_f1": F.lit(fixed_f1), "tuned": tuned if tuned is not None else F.lit(None).cast("double")}.get(mode, F.lit(None).cast("double")), F.lit(0.5))


def isotonic(preds: DataFrame, least: int = 10) -> DataFrame:
    """Calibrated predictions of one class.

    Without rows 1/2; with one label or fewer than ``least`` rows the mean label;
    else isotonic regression. The column ``calibrated`` is clipped to 0 to 1.
    """
    from pyspark.ml.regression import IsotonicRegression

    n, low, high, mean = preds.agg(F.count("y"), F.min("y"), F.max("y"), F.avg("y")).first()
    if n < least or low == high:
        return preds.withColumn("calibrated", F.lit(0.5 if mean is None else float(mean)))
    model = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="calibrated").fit(preds.where("y is not null and p is not null"))
    return model.transform(preds).withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")))
