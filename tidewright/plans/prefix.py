"""Running sums over large groups without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.session import cut

BUCKETS = 1024


def running_sums(df: DataFrame, groups: list[str], order: str, values: list[str], descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """df with ``run_<value>``, the sum up to and with each row, ``all_<value>``, that of the group, and ``next_order``.

    ``order`` is a number, distinct in its group, not null. Rows are put into
    buckets of equal width between the group's ends; bucket totals, at most
    ``buckets`` + 1 rows a group, give the offsets, and each bucket is cumulated
    by itself. ``next_order`` is the following value of the order, null at the end.
    """
    sign = -1 if descending else 1
    first, last = (F.max, F.min) if descending else (F.min, F.max)
    null_safe = lambda a, b: [a[g].eqNullSafe(b[f"__{g}"]) for g in groups]
    ends = df.groupBy(*groups).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi")).withColumnsRenamed({g: f"__{g}" for g in groups})
    if groups:
        ended = df.join(ends, null_safe(df, ends)).drop(*(f"__{g}" for g in groups))
    else:
        ended = df.withColumns({c: ends.select(c).scalar() for c in ("__lo", "__hi")})
    width = F.col("__hi") - F.col("__lo")
    at = F.when(width > 0, F.floor((F.col(order) - F.col("__lo")) / width * buckets)).otherwise(F.lit(0)).cast("bigint")
    placed = ended.withColumn("__b", sign * at).drop("__lo", "__hi")
    totals = placed.groupBy(*groups, "__b").agg(*(F.sum(v).alias(f"__t_{v}") for v in values), first(order).alias("__first"))
    along, whole = W.partitionBy(*groups).orderBy("__b"), W.partitionBy(*groups)
    offsets = totals.select(*groups, "__b", F.lead("__first").over(along).alias("__next"), *(F.sum(f"__t_{v}").over(along.rowsBetween(W.unboundedPreceding, -1)).alias(f"__o_{v}") for v in values), *(F.sum(f"__t_{v}").over(whole).alias(f"all_{v}") for v in values))
    offsets = offsets.withColumnsRenamed({g: f"__{g}" for g in groups} | {"__b": "__c"})
    joined = placed.join(offsets, [*null_safe(placed, offsets), placed["__b"] == offsets["__c"]]).drop(*(f"__{g}" for g in groups), "__c")
    inside = W.partitionBy(*groups, "__b").orderBy(F.desc(order) if descending else F.asc(order))
    run = {f"run_{v}": F.coalesce(f"__o_{v}", F.lit(0)) + F.sum(v).over(inside.rowsBetween(W.unboundedPreceding, 0)) for v in values}
    return joined.withColumns(run | {"next_order": F.coalesce(F.lead(order).over(inside), "__next")}).drop("__b", "__next", *(f"__o_{v}" for v in values))


def ordered_sums(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """df with ``run_<value>``, the sum up to and with each row in the order of a column of any kind, distinct and not null.

    Rows are sorted into ranges, each cumulated by itself behind the totals of
    those before it, a row per range.
    """
    placed = cut(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    totals = placed.groupBy("__p").agg(*(F.sum(v).alias(f"__t_{v}") for v in values))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__p", *(F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in values))
    inside = W.partitionBy("__p").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return placed.join(F.broadcast(offsets), "__p").withColumns({f"run_{v}": F.col(f"__o_{v}") + F.sum(v).over(inside) for v in values}).drop("__p", *(f"__o_{v}" for v in values))


def value_ranks(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, n, rank): number of rows of each distinct value and their common rank, ties at the mean."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, groups, value, ["n"]).select(*groups, value, "n", (F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
