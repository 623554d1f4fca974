"""Observer aggregation with duplicate resolution, and agreement of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tidewright.plans.prefix import ordered_sums

from tidewright.sources.tables import unpivoted


def mismatched_groups(df: DataFrame, keys: list[str], count: int = 2) -> DataFrame:
    """Groups of another number of rows than expected."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") != count)


def resolved_rows(df: DataFrame, keys: list[str], observer: str, classes: list[str], order: str, count: int = 2) -> DataFrame:
    """The rows that enter the aggregation.

    A group of the expected size stays. One of another size stays as one copy of
    each row when every row has an exact copy and the distinct rows are as many
    as expected; otherwise it goes. Groups with a null key stay as they are.
    One shuffle by key serves all windows.
    """
    group, same = W.partitionBy(*keys), W.partitionBy(*keys, observer, *classes)
    marked = df.withColumns({"__copies": F.count(F.lit(1)).over(same), "__rn": F.row_number().over(same.orderBy(order)), "__n": F.count(F.lit(1)).over(group)})
    marked = marked.withColumns({"__least": F.min("__copies").over(group), "__uniq": F.sum((F.col("__rn") == 1).cast("int")).over(group)})
    whole = (F.col("__least") >= 2) & (F.col("__uniq") == count) & (F.col("__rn") == 1)
    null_key = F.expr(" or ".join(f"`{k}` is null" for k in keys))
    return marked.where((F.col("__n") == count) | whole | null_key).drop("__copies", "__rn", "__n", "__least", "__uniq")


def _aggregated(df: DataFrame, keys: list[str], observer: str, classes: list[str], order: str, count: int, extra: list[str] = (), together: list[str] = ()) -> DataFrame:
    """``aggregate_observers``: copies are counted, before they are shuffled, then groups judged; nothing is sorted.

    Distinct rows are put together by ``together``, if given, for what follows.
    """
    first = [F.expr(f"min_by(struct(`{c}`, `{order}`), `{order}`) filter (where `{c}` is not null)").alias(f"__e_{c}") for c in extra]
    rows = df.groupBy(*keys, observer, *classes).agg(F.count(F.lit(1)).alias("__copies"), *first)
    rows = rows.repartition(*together) if together else rows
    whole = F.col("__n") == count
    null_key = F.expr(" or ".join(f"`{k}` is null" for k in keys))
    once = (F.col("__least") >= 2) & (F.col("__uniq") == count)
    sums = [x for c in classes for x in (F.sum(F.col(c) * F.col("__copies")).alias(f"__w_{c}"), F.sum(F.when(F.col(c).isNotNull(), F.col("__copies"))).alias(f"__m_{c}"), F.avg(c).alias(f"__a_{c}"))]
    firsts = [F.expr(f"min_by(`__e_{c}`.`{c}`, `__e_{c}`.`{order}`)").alias(c) for c in extra]
    groups = rows.groupBy(*keys).agg(F.sum("__copies").alias("__n"), F.min("__copies").alias("__least"), F.count(F.lit(1)).alias("__uniq"), *sums, *firsts, F.array_sort(F.collect_set(observer)).alias("physician_ids"))
    kept = groups.where(whole | once | null_key)
    # copies weigh where all rows count, and not where only one of each is kept
    mean = lambda c: F.when(whole | null_key, F.col(f"__w_{c}") / F.col(f"__m_{c}")).otherwise(F.col(f"__a_{c}")).alias(c)
    return kept.select(*keys, *map(mean, classes), *extra, "physician_ids")


def aggregate_observers(df: DataFrame, keys: list[str], observer: str, classes: list[str], order: str, count: int = 2, extra: list[str] = (), on_mismatch: str = "drop") -> DataFrame:
    """One row per group: mean of each class, the first non-null extra columns, the sorted distinct observers.

    The groups kept are those of ``resolved_rows``.
    """
    if on_mismatch == "error" and not mismatched_groups(df, keys, count).isEmpty():
        raise ValueError("groups of another size than expected")
    return _aggregated(df.select(*keys, observer, *classes, *{order, *extra}), keys, observer, classes, order, count, extra)


def paired_labels(df: DataFrame, keys: list[str], condition: str, before: str, after: str, observer: str, classes: list[str], order: str, count: int = 2) -> DataFrame:
    """``reference_labels`` of both conditions in one pass: distinct rows are shuffled by key once, for aggregation and pairing alike."""
    wide = paired_wide_labels(df, keys, condition, before, after, observer, classes, order, count)
    cells = F.array(*(F.struct(F.lit(c).alias("category"), F.col("a")[c].alias("survey"), F.col("b")[c].alias("interview")) for c in classes))
    return wide.select(*keys, F.inline(cells)).withColumn("delta", F.col("interview") - F.col("survey"))


def paired_wide_labels(df: DataFrame, keys: list[str], condition: str, before: str, after: str, observer: str, classes: list[str], order: str, count: int = 2) -> DataFrame:
    """``paired_labels`` before the classes are unpivoted: (keys, a, b), structs of classes before and after, placed by the keys."""
    rows = df.where(F.col(condition).isin(before, after)).dropna(subset=keys).select(condition, *keys, observer, *classes, order)
    done = _aggregated(rows, [condition, *keys], observer, classes, order, count, together=keys)
    side = lambda name: F.max(F.when(F.col(condition) == name, F.struct(*classes)))
    return done.groupBy(*keys).agg(side(before).alias("a"), side(after).alias("b")).where("a is not null and b is not null")


def merged_conditions(test: DataFrame, interview: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """Each aggregated test row with its interview row, whose classes get the suffix _interview."""
    after = interview.select(*keys, *(F.col(c).alias(f"{c}_interview") for c in classes))
    return test.select(*keys, *classes).join(after, keys, "left")


def reference_labels(test: DataFrame, interview: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """(keys, category, survey, interview, delta): both consensus labels and their difference."""
    a = unpivoted(test, keys, classes, value="survey")
    b = unpivoted(interview, keys, classes, value="interview")
    return a.join(b, [*keys, "category"]).withColumn("delta", F.col("interview") - F.col("survey"))


def triplet_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations of one side only, as sets; null keys compare as equal."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def triplet_multiset_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations that one side has more often, with the excess."""
    a = left.select(*keys).exceptAll(right.select(*keys)).withColumn("side", F.lit("left"))
    b = right.select(*keys).exceptAll(left.select(*keys)).withColumn("side", F.lit("right"))
    return a.unionByName(b).groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("excess"))


def shuffled_assignment(pairs: DataFrame, entity: str, item: str, seed: int, weighting: str = "patient") -> DataFrame:
    """For each (entity, item) one other entity, drawn by hash.

    The draw is an index into the other entities, found by rank, so no entity
    is paired with all others. weighting "patient" takes each other entity with
    equal chance, "pair" by its number of pairs.
    """
    distinct = pairs.select(entity, item).distinct()
    weight = F.count(F.lit(1)) if weighting == "pair" else F.lit(1).cast("bigint")
    sizes = distinct.groupBy(entity).agg((F.count(F.lit(1)) if weighting == "pair" else F.max(weight)).alias("w"))
    summed = ordered_sums(sizes, entity, ["w"]).withColumnRenamed("run_w", "upto")
    ranked = summed.withColumns({"total": summed.select(F.sum("w")).scalar(), "before": F.col("upto") - F.col("w")})
    own = ranked.select(entity, "w", "before", "total")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), entity, item)), 1, 8), 16, 10).cast("bigint")
    drawn = distinct.join(own, entity).where("total > w").withColumn("slot", F.pmod(draw, F.col("total") - F.col("w")))
    drawn = drawn.withColumn("slot", F.when(F.col("slot") >= F.col("before"), F.col("slot") + F.col("w")).otherwise(F.col("slot")))
    slots = ranked.select(F.col(entity).alias("context_entity"), F.explode(F.sequence("before", F.col("upto") - 1)).alias("slot"))
    return drawn.join(slots, "slot").select(entity, item, "context_entity")
