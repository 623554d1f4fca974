"""Patient-grouped folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.resample import hash_number
from tidewright.plans.prefix import ordered_sums, running_sums


def leave_one_out(rows: DataFrame, entity: str) -> DataFrame:
    """(entity, fold): one fold per sorted entity. Fewer than two are an error where the folds are used."""
    one = rows.where(F.col(entity).isNotNull()).select(entity).distinct().withColumn("__n", F.lit(1))
    return ordered_sums(one, entity, ["__n"]).select(entity, (F.col("run___n") - 1).cast("int").alias("fold"))


def hash_folds(rows: DataFrame, entity: str, k: int, seed: int) -> DataFrame:
    """(entity, fold): entities in hash order dealt into k folds, as even as can be.

    Entities of one hash are ordered by name; positions come from running sums
    over hash buckets, so no task holds all entities.
    """
    hashed = rows.where(F.col(entity).isNotNull()).select(entity).distinct().withColumn("__h", hash_number(F.lit(str(seed)), F.col(entity).cast("string")))
    counts = running_sums(hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_list(entity)).alias("__e")), [], "__h", ["__n"])
    dealt = counts.select(F.posexplode("__e").alias("__i", entity), (F.col("run___n") - F.col("__n")).alias("__o"))
    return dealt.select(entity, ((F.col("__o") + F.col("__i")) % k).cast("int").alias("fold"))


def group_folds(spark, entities: list[str], k: int, seed: int) -> DataFrame:
    """(entity, fold) from numpy's permutation of the sorted entities, parts as even as can be; for an entity list that the driver holds."""
    unique = np.unique(np.array(entities, dtype=str))
    if len(unique) < 2:
        raise ValueError("folds need at least two entities")
    order = np.random.default_rng(seed).permutation(unique)
    parts = np.array_split(order, min(k, len(unique)))
    return spark.createDataFrame([(str(e), i) for i, part in enumerate(parts) for e in part], "entity string, fold int")


def with_folds(rows: DataFrame, folds: DataFrame, entity: str) -> DataFrame:
    return rows.join(folds, entity, "left")


def fold_sizes(rows: DataFrame, folds: DataFrame, entity: str) -> DataFrame:
    """Per fold the entities and rows held out and the rows left for training."""
    per = with_folds(rows, folds, entity).where("fold is not null").groupBy("fold").agg(F.count_distinct(entity).alias("n_entities"), F.count(F.lit(1)).alias("n_held_out"))
    return per.withColumn("n_train", F.sum("n_held_out").over(W.partitionBy()) - F.col("n_held_out"))  # one row per fold


def fold_predictions(rows: DataFrame, folds: DataFrame, preds: DataFrame, entity: str, row: str) -> DataFrame:
    """Each row with the prediction of the fold that held its entity out; null where there is none."""
    return with_folds(rows, folds, entity).join(preds, ["fold", row], "left")


def unfinished_folds(folds: DataFrame, done: DataFrame) -> DataFrame:
    """The folds without a stored result."""
    return folds.select("fold").distinct().join(done.select("fold").distinct(), "fold", "left_anti")
