"""Consensus from several annotators' labels.

Of one annotator's votes on an item the latest holds (ties: loaded last, then
the larger label id); a null vote says nothing. Item labels and annotators'
2x2 confusion matrices are estimated by expectation-maximisation with smoothing:

- E: the log odds of an item's label are the prior of its category plus the
  evidence of each vote under its annotator's matrix;
- M: matrices and priors are the expected counts plus SMOOTH pseudo counts.

The votes are kept hashed and sorted by item, so an iteration needs one pass, no
shuffle of votes, and a small aggregation by annotator. The annotators'
parameters are broadcast while they are at most BROADCAST_ROWS rows and
shuffle-joined beyond.

Chance-corrected agreement (Krippendorff's alpha for nominal labels, which
allows for a varying number of votes) is computed from the votes alone.

An item whose votes are all null has no label. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.session import cut

SMOOTH = 1.0
ROUNDS = 40
TOLERANCE = 1e-4
BROADCAST_ROWS = 200_000


def valid_votes(votes: DataFrame, item_cols: list[str], observer: str = "physician", vote: str = "vote", at: str = "voted_at", loaded: str = "loaded_at", id_col: str = "label_id") -> DataFrame:
    """(item columns, observer, vote): the vote that holds for each observer and item, null votes left out."""
    last = F.max_by(F.col(vote), F.struct(at, loaded, id_col))
    held = votes.where(F.col(observer).isNotNull()).groupBy(*item_cols, F.col(observer).alias("observer")).agg(last.alias("vote"))
    return held.where("vote is not null")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fit(votes: DataFrame, item_cols: list[str], category: str, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(items, observers) of the votes that hold.

    items: item columns, n_votes, n_ones, posterior of label 1. observers:
    observer, n_votes, sensitivity, specificity.
    """
    kept = votes.repartition(*item_cols).sortWithinPartitions(*item_cols).persist()
    item = W.partitionBy(*item_cols)
    start = kept.withColumn("p", (F.sum("vote").over(item) + 0.5) / (F.count("vote").over(item) + 1.0))
    key = F.explode(F.array(F.concat(F.lit("o:"), "observer"), F.concat(F.lit("c:"), F.col(category).cast("string")))).alias("key")

    def counts(scored: DataFrame) -> DataFrame:
        """Expected counts of each observer and, weighted to one an item, of each category."""
        weight = F.when(F.startswith("key", F.lit("o:")), 1.0).otherwise(1.0 / F.col("n"))
        keyed = scored.withColumn("n", F.count("vote").over(item)).select(key, "vote", "p", "n").withColumn("g", weight)
        sums = keyed.groupBy("key").agg(
            F.sum(F.col("p") * F.col("vote") * F.col("g")).alias("tp"), F.sum(F.col("p") * F.col("g")).alias("pos"),
            F.sum((1 - F.col("p")) * (1 - F.col("vote")) * F.col("g")).alias("tn"), F.sum((1 - F.col("p")) * F.col("g")).alias("neg"),
            F.count(F.lit(1)).alias("n_votes"),
        )
        smooth = F.lit(SMOOTH)
        return cut(
            sums.select(
                "key", "n_votes",
                ((F.col("tp") + 2 * smooth) / (F.col("pos") + 3 * smooth)).alias("sens"),
                ((F.col("tn") + 2 * smooth) / (F.col("neg") + 3 * smooth)).alias("spec"),
                ((F.col("pos") + smooth) / (F.col("pos") + F.col("neg") + 2 * smooth)).alias("prior"),
            )
        )

    def expect(found: DataFrame, rows: int) -> DataFrame:
        obs = found.where(F.startswith("key", F.lit("o:"))).select(F.substring("key", 3, 1_000_000).alias("observer"), "sens", "spec")
        cat = found.where(F.startswith("key", F.lit("c:"))).select(F.substring("key", 3, 1_000_000).alias("__cat"), "prior")
        given = kept.join(_small(obs, rows), "observer").join(_small(cat, rows), kept[category].cast("string") == F.col("__cat")).drop("__cat")
        yes = F.log("sens") - F.log(1 - F.col("spec"))
        no = F.log(1 - F.col("sens")) - F.log("spec")
        odds = F.sum(F.when(F.col("vote") == 1, yes).otherwise(no)).over(item) + F.log("prior") - F.log(1 - F.col("prior"))
        return given.withColumn("p", 1 / (1 + F.exp(-odds)))

    found = counts(start)
    rows = found.count()
    for _ in range(rounds):
        new = counts(expect(found, rows))
        change = F.greatest(*(F.abs(F.col(f"n.{c}") - F.col(f"o.{c}")) for c in ("sens", "spec", "prior")))
        moved = new.alias("n").join(found.alias("o"), "key").agg(F.max(change)).first()[0]
        found = new
        if moved is None or moved < tolerance:
            break
    scored = expect(found, rows)
    items = scored.groupBy(*item_cols).agg(F.count(F.lit(1)).alias("n_votes"), F.sum("vote").cast("bigint").alias("n_ones"), F.max("p").alias("posterior"))
    observers = found.where(F.startswith("key", F.lit("o:"))).select(F.substring("key", 3, 1_000_000).alias("observer"), "n_votes", F.col("sens").alias("sensitivity"), F.col("spec").alias("specificity"))
    return items, observers


def consensus(votes: DataFrame, item_cols: list[str], category: str, **names: str) -> DataFrame:
    """One row per item: n_votes, n_ones, posterior, label (posterior at least 1/2) and the share of votes for that label."""
    items, _ = fit(valid_votes(votes, item_cols, **names), item_cols, category)
    label = (F.col("posterior") >= 0.5).cast("int")
    agree = F.when(F.col("label") == 1, F.col("n_ones")).otherwise(F.col("n_votes") - F.col("n_ones")) / F.col("n_votes")
    return items.withColumn("label", label).withColumn("agreement", agree)


def reliability(votes: DataFrame, item_cols: list[str], category: str, **names: str) -> DataFrame:
    """One row per observer: votes, sensitivity, specificity and their mean (balanced accuracy)."""
    _, observers = fit(valid_votes(votes, item_cols, **names), item_cols, category)
    return observers.withColumn("balanced", (F.col("sensitivity") + F.col("specificity")) / 2)


def agreement(votes: DataFrame, item_cols: list[str], category: str, **names: str) -> DataFrame:
    """Per category: items with two votes or more, observed and expected disagreement, and Krippendorff's alpha.

    alpha is null when all votes are equal.
    """
    item = valid_votes(votes, item_cols, **names).groupBy(*item_cols).agg(F.count("vote").alias("n"), F.sum("vote").alias("ones")).where("n > 1")
    per = item.groupBy(category).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n_votes"), F.sum("ones").alias("ones"), F.sum(2 * F.col("ones") * (F.col("n") - F.col("ones")) / (F.col("n") - 1)).alias("unlike")
    )
    seen = F.col("unlike") / F.col("n_votes")
    chance = 2 * F.col("ones") * (F.col("n_votes") - F.col("ones")) / (F.col("n_votes") * (F.col("n_votes") - 1))
    return per.select(category, "n_items", "n_votes", seen.alias("observed"), chance.alias("expected"), F.when(chance > 0, 1 - seen / chance).alias("alpha"))
