"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import consensus, formatting, leakage, lookalike, mapping, mixing, overlap, private, splits
from tidewright.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
IDS = ["patient_id", "author_id", "source_id"]
SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
TOKENIZER = "byte_bpe_50k.tiktoken"
#: A key for the tests; a real one comes from the caller.
KEY = b"a key of the test tables"
ITEM = ["pair_id", "category"]
RATING = {"id_col": "row_id", "texts": ["patient"], "lists": ["item"], "ignore": ["loaded_at"], "required": ["patient", "physician", "item"]}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = splits.grouped(table(spark, sf, "study_rows"), "row_id", IDS)
    return groups.where("root is not null").select("row_id", "group_no")


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    assigned = splits.assign_splits(splits.grouped(table(spark, sf, "study_rows"), "row_id", IDS), SHARES)
    return assigned.select("row_id", "split", "group_no")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_report(splits.assign_splits(splits.grouped(table(spark, sf, "study_rows"), "row_id", IDS), SHARES))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = private.mentions(table(spark, sf, "patient_summaries"), "summary_id", ["summary"], ["medical_history", "social_history"], KEY)
    return found.select("summary_id", "field_name", "elem_no", "kind", "begin_at")


def p2_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return private.mentions(table(spark, sf, "patient_summaries"), "summary_id", ["summary"], ["medical_history", "social_history"], KEY)


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return private.redacted(table(spark, sf, "patient_summaries"), ["summary"], ["medical_history", "social_history"], KEY).select("summary_id", "summary", "medical_history", "social_history")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return p2_found(spark, sf).groupBy("field_name", "kind").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("summary_id").alias("n_records"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.copy_links(table(spark, sf, "ratings"), **RATING)


def p3_copies(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.copies(table(spark, sf, "ratings"), **RATING)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.consensus(table(spark, sf, "observer_votes"), ITEM, "category").where("label = 1").select("pair_id", "category")


def p4_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.consensus(table(spark, sf, "observer_votes"), ITEM, "category")


def p4_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.reliability(table(spark, sf, "observer_votes"), ITEM, "category")


def p4_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.agreement(table(spark, sf, "observer_votes"), ITEM, "category")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = overlap.overlaps(table(spark, sf, "study_rows"))
    return pairs.select(F.least("row_train", "row_eval").alias("row_id_a"), F.greatest("row_train", "row_eval").alias("row_id_b"))


def p5_links(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, sf, "study_rows"))[0]


def p5_members(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, sf, "study_rows"))[1]


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf, "study_rows"))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.mapped(table(spark, sf, "item_entries").where("not item_json_resolved"), table(spark, sf, "item_mapping"), "item")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("entry_id", F.col("mapped_id").alias("canonical_id"))


def p6_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.unmatched_report(_mapped(spark, sf), "item")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("eval_id", "doc_id")


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    evals = table(spark, sf, "eval_items")
    return leakage.leaked_items(evals, leakage.leaks(table(spark, sf, "documents"), evals))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return leakage.without_leaks(docs, leakage.leaks(docs, table(spark, sf, "eval_items")))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return mixing.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), str(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN, count_soft=True)


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture_report(p8_mixture(spark, sf), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, sf, "documents"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.alike_classes(table(spark, sf, "documents"))


def p9_texts(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.one_form(table(spark, sf, "documents")).select("doc_id", "text_form")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from tidewright.llm import oracles

    return oracles.SQL
