"""Stage by stage data-quality summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.text import bare_item, trimmed
from tidewright.sources.tables import unpivoted

TOTAL = "Total"


def binary(column: str | Column) -> Column:
    """1 for a positive number, else 0; what is no number counts as 0."""
    column = F.col(column) if isinstance(column, str) else column
    return (F.coalesce(column.try_cast("double"), F.lit(0.0)) > 0).cast("int")


def share(part: Column, whole: Column) -> Column:
    return 100.0 * part / F.greatest(whole, F.lit(1))


def delta_distribution(reference: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Per category, and per Total, counts of rises, falls and exact steps of the reference delta and their percentages of valid ones."""
    rows = reference.withColumn("category", F.explode(F.array(F.col("category"), F.lit(TOTAL))))
    steps = {"n_positive": "delta > 0", "n_negative": "delta < 0", "n_zero": "delta = 0", "n_minus_one": "delta = -1", "n_plus_one": "delta = 1", "n_minus_half": "delta = -0.5", "n_plus_half": "delta = 0.5"}
    counts = rows.groupBy(*extra, "category").agg(F.count("delta").alias("n_valid"), *(F.count_if(F.expr(e)).alias(n) for n, e in steps.items()))
    return counts.withColumns({n.replace("n_", "pct_", 1): F.when(F.col("n_valid") > 0, 100.0 * F.col(n) / F.col("n_valid")).otherwise(0.0) for n in steps})


def stage_stats(rows: DataFrame, stage: str = "sheet") -> DataFrame:
    """Rows, distinct items and patients, and missing items per stage."""
    return rows.groupBy(stage).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("item").alias("n_items"), F.count_distinct("patient").alias("n_patients"), F.count_if(F.col("item").isNull()).alias("n_missing_items"))


def missingness(rows: DataFrame, columns: list[str], stage: str = "sheet") -> DataFrame:
    """Null count and percentage per stage and column, in one pass."""
    counts = rows.groupBy(stage).agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = counts.unpivot([stage, "__n"], columns, "column_name", "n_missing")
    return long.select(stage, "column_name", "n_missing", share(F.col("n_missing"), F.col("__n")).alias("pct_missing"))


def entity_distribution(rows: DataFrame, entity: str = "patient") -> DataFrame:
    """Rows per entity, nulls included, and their percentage."""
    counts = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"))
    total = rows.agg(F.count(F.lit(1)).alias("__n"))
    return counts.select(entity, "n_rows", share(F.col("n_rows"), total.scalar()).alias("pct"))


def class_distribution(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Positive rows per class and their percentage."""
    sums = rows.agg(F.count(F.lit(1)).alias("__n"), *(F.sum(binary(c)).alias(c) for c in classes))
    long = sums.unpivot(["__n"], classes, "category", "n_positive")
    return long.select("category", F.coalesce("n_positive", F.lit(0)).alias("n_positive"), share(F.coalesce("n_positive", F.lit(0)), F.col("__n")).alias("pct"))


def cooccurrence(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Rows in which two classes are both positive, for all pairs of classes.

    Rows are counted per combination of labels first, and combinations then
    taken apart into pairs.
    """
    held = F.array_compact(F.array(*(F.when(binary(c) == 1, F.lit(c)) for c in classes)))
    combos = rows.groupBy(held.alias("held")).agg(F.count(F.lit(1)).alias("n"))
    pairs = combos.select(F.explode("held").alias("class_a"), "held", "n").select("class_a", F.explode("held").alias("class_b"), "n").groupBy("class_a", "class_b").agg(F.sum("n").alias("n_both"))
    names = rows.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "class_a string, class_b string")
    return names.join(pairs, ["class_a", "class_b"], "left").na.fill(0, ["n_both"])


def text_length(rows: DataFrame, text: str = "text") -> DataFrame:
    """Words per text: count, median, least, most, mean and population deviation."""
    n = F.size(F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0)))
    words = rows.where(F.col(text).isNotNull()).select(n.alias("n"))
    return words.agg(F.count("n").alias("n_texts"), F.median("n").alias("median_words"), F.min("n").alias("min_words"), F.max("n").alias("max_words"), F.avg("n").alias("mean_words"), F.stddev_pop("n").alias("std_words"))


def text_length_bins(rows: DataFrame, text: str = "text", bins: int = 20) -> DataFrame:
    """Texts per bin of equal width between the least and most words; bins are closed on the right, the first one on both sides."""
    words = rows.where(F.col(text).isNotNull()).select(F.size(F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0))).alias("n"))
    ends = words.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.greatest(F.lit(0), F.ceil((F.col("n") - F.col("lo")) / step - 1e-9) - 1))
    return words.withColumns({"lo": ends.select("lo").scalar(), "hi": ends.select("hi").scalar()}).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_texts"))


def entity_class_counts(rows: DataFrame, classes: list[str], entity: str = "patient") -> DataFrame:
    """Rows per entity, raw class sums, and the binary labels per class summed to a burden."""
    burden = sum((binary(c) for c in classes[1:]), binary(classes[0]))
    return rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(F.col(c)).alias(f"sum_{c}") for c in classes), F.sum(burden).alias("n_labels"))


def label_cardinality(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Mean labels per row and the percentages of rows with 0, 1, 2 and 3 or more."""
    n = sum((binary(c) for c in classes[1:]), binary(classes[0]))
    rate = lambda c: 100 * F.avg(c.cast("double"))
    return rows.select(n.alias("n")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("n").alias("mean_labels"), rate(F.col("n") == 0).alias("pct_0"), rate(F.col("n") == 1).alias("pct_1"), rate(F.col("n") == 2).alias("pct_2"), rate(F.col("n") > 2).alias("pct_3_or_more"))


def label_cardinality_distribution(rows: DataFrame, classes: list[str]) -> DataFrame:
    n = sum((binary(c) for c in classes[1:]), binary(classes[0]))
    return rows.groupBy(n.alias("n_labels")).agg(F.count(F.lit(1)).alias("n_rows"))


def positive_buckets(rows: DataFrame, classes: list[str], entity: str = "patient") -> DataFrame:
    """Per class: positives, prevalence, and entities with 0, 1, 2, 3, 4 and fewer than 5 positives."""
    per = unpivoted(rows.where(F.col(entity).isNotNull()), [entity], classes).groupBy("category", entity).agg(F.sum(binary("score")).alias("p"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("category").agg(
        F.sum("p").alias("n_positive"), (F.sum("p") / F.sum("n")).alias("prevalence"), *(F.count_if(F.col("p") == k).alias(f"entities_with_{k}") for k in range(5)), F.count_if(F.col("p") < 5).alias("entities_below_5")
    )


def fractional_audit(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Per class the exact zeros, exact ones and other values, and whether labels are binary or fractional."""
    per = unpivoted(rows, [], classes).where("score is not null").groupBy("category").agg(F.count_if(F.col("score") == 0).alias("n_zero"), F.count_if(F.col("score") == 1).alias("n_one"), F.count_if(~F.col("score").isin(0.0, 1.0)).alias("n_fractional"))
    return per.withColumn("label_type", F.when(F.col("n_fractional") > 0, "fractional").otherwise("binary"))


def fractional_values(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Value counts per class, their percentage within it, and the dense rank of the count over all."""
    counts = unpivoted(rows, [], classes).where("score is not null").groupBy("category", F.col("score").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({"pct": 100.0 * F.col("n") / F.sum("n").over(W.partitionBy("category")), "rank": F.dense_rank().over(W.orderBy(F.desc("n")))})  # distinct values only


def duplicate_profile(rows: DataFrame, exact: list[str]) -> DataFrame:
    """Excess exact copies, and numbers of repeated patient-item groups, triplets and items."""
    def repeated(keys: list[str], name: str, excess: bool = False) -> DataFrame:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        value = F.sum(F.col("n") - 1) if excess else F.count_if(F.col("n") > 1)
        return counts.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("value")).select(F.lit(name).alias("measure"), "value")

    parts = [repeated(exact, "exact_excess", True), repeated(["patient", "item"], "patient_item_groups"), repeated(["patient", "physician", "item"], "triplet_excess", True), repeated(["item"], "item_groups")]
    return reduce(DataFrame.unionByName, parts)


def item_frequency(rows: DataFrame, item: str = "item") -> DataFrame:
    """Rows per trimmed item and their percentage of all rows."""
    items = rows.select(trimmed(F.col(item)).alias("item"))
    counts = items.where("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = items.agg(F.count(F.lit(1)).alias("__n"))
    return counts.select("item", "n", share(F.col("n"), total.scalar()).alias("pct"))


def standardisation_impact(rows: DataFrame, raw: str, standard: str, stage: str = "sheet") -> DataFrame:
    """Per stage: distinct raw and standardised forms, rows changed, and standard forms with several raw ones."""
    pairs = rows.where(F.col(raw).isNotNull()).groupBy(stage, F.col(raw).alias("r"), F.col(standard).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    forms = pairs.groupBy(stage, "s").agg(F.count_distinct("r").alias("raw_forms"), F.sum("n").alias("n"), F.sum(F.when(F.col("r") != F.col("s"), F.col("n")).otherwise(0)).alias("changed"))
    raws = pairs.groupBy(stage).agg(F.count_distinct("r").alias("n_raw"))
    return forms.groupBy(stage).agg(F.count("s").alias("n_standard"), F.sum("changed").alias("n_changed"), F.count_if(F.col("raw_forms") > 1).alias("n_collapsed")).join(raws, stage)


def split_overlap(rows: DataFrame, splits: list[tuple[str, str]], item: str = "item", stage: str = "sheet") -> DataFrame:
    """Common and all items of two splits, their Jaccard index (0 for empty sets), and those of one split only."""
    items = rows.select(F.col(stage).alias("split"), bare_item(F.col(item)).alias("i")).where("i is not null and i <> ''").groupBy("i").agg(F.collect_set("split").alias("in_splits"))
    parts = []
    for a, b in splits:
        has = lambda s: F.array_contains("in_splits", s)
        counts = items.agg(F.count_if(has(a) & has(b)).alias("n_common"), F.count_if(has(a) | has(b)).alias("n_union"), F.count_if(has(a) & ~has(b)).alias("n_only_a"), F.count_if(~has(a) & has(b)).alias("n_only_b"))
        parts.append(counts.select(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), "*"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("jaccard", F.when(F.col("n_union") > 0, F.col("n_common") / F.col("n_union")).otherwise(0.0))


def disagreement(rows: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """Groups of several rows, and per class those with several values, as count and rate."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *((F.count_distinct(c) > 1).cast("int").alias(c) for c in classes)).where("__n > 1")
    sums = groups.agg(F.count(F.lit(1)).alias("n_groups"), *(F.sum(c).alias(c) for c in classes))
    long = sums.unpivot(["n_groups"], classes, "category", "n_conflicting")
    return long.select("category", "n_groups", F.coalesce("n_conflicting", F.lit(0)).alias("n_conflicting"), (F.coalesce("n_conflicting", F.lit(0)) / F.greatest("n_groups", F.lit(1))).alias("rate"))


def conflicting_groups(rows: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """Groups of several rows that conflict in a class, with the number of such classes."""
    conflicts = sum(((F.count_distinct(c) > 1).cast("int") for c in classes[1:]), (F.count_distinct(classes[0]) > 1).cast("int"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), conflicts.alias("n_conflicts")).where("n_rows > 1 and n_conflicts > 0")


def observer_agreement(rows: DataFrame, classes: list[str], order: str, stage: str = "sheet") -> DataFrame:
    """Per stage and patient: how often the first two observers of a patient give equal labels on items that both labelled."""
    whole = rows.where("patient is not null and physician is not null and item is not null")
    pairs = whole.select(stage, "patient", "physician").distinct()  # ranked before the rows are touched: a patient may hold many
    first = pairs.withColumn("obs", F.row_number().over(W.partitionBy(stage, "patient").orderBy("physician"))).where("obs <= 2")
    one = whole.join(first, [stage, "patient", "physician"]).withColumn("rn", F.row_number().over(W.partitionBy(stage, "patient", "item", "physician").orderBy(F.desc(order)))).where("rn = 1")
    wide = one.groupBy(stage, "patient", "item").agg(F.max(F.when(F.col("obs") == 1, F.array(*classes))).alias("a"), F.max(F.when(F.col("obs") == 2, F.array(*classes))).alias("b")).where("a is not null and b is not null")
    long = wide.select(stage, "patient", F.inline(F.arrays_zip("a", "b"))).where("a is not null and b is not null")
    return long.groupBy(stage, "patient").agg(F.count(F.lit(1)).alias("n_labels"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))
