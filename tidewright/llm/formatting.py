"""Duplicates hidden by formatting differences.

Each record becomes a canonical key: text columns lose whitespace, case and
punctuation (punctuation between two digits is content and stays), the parts of
list-like columns are sorted, all other columns count as they are, nulls
agreeing. The 16-byte digest of the canonical columns is the group key.

Hot keys are found exactly from partial counts; they are grouped on two levels,
first by (key, salt), then by key, and only their few rows of totals are joined
back. All other keys take one shuffle. The representative is the smallest id.

Rows with a null in a required column never count. An empty table gives an
empty result; a repeated id is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.plans.skew import SALTS, hot_keys

PARTS = "[;|]"
#: A mark that isn't between two digits; blanks go in any case.
LOOSE = r"(?<![0-9])[\p{P}\p{S}\p{C}]|[\p{P}\p{S}\p{C}](?![0-9])|[\s\p{Z}]"
#: Stands for null; no canonical text can hold it.
NOTHING = "\u0000"


def bare(text: Column) -> Column:
    """Text without whitespace, case and loose punctuation."""
    return F.lower(F.regexp_replace(text, LOOSE, ""))


def bare_parts(text: Column) -> Column:
    """The sorted bare parts of a text that is divided by ; or |, empty parts left out."""
    parts = F.transform(F.split(text, PARTS), bare)
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), "\u0001")


def canonical_key(df: DataFrame, exact: list[str], texts: list[str], lists: list[str]) -> Column:
    """The digest of the canonical columns."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit(NOTHING)) for c in exact]
    columns += [F.coalesce(bare(F.col(c)), F.lit(NOTHING)) for c in texts] + [F.coalesce(bare_parts(F.col(c)), F.lit(NOTHING)) for c in lists]
    return F.unhex(F.md5(F.concat_ws("\u0002", *columns)))


def _keyed(df: DataFrame, id_col: str, texts: list[str], lists: list[str], ignore: list[str], required: list[str]) -> DataFrame:
    exact = [c for c in df.columns if c not in {id_col, *texts, *lists, *ignore}]
    present = df
    for column in required:
        present = present.where(F.col(column).isNotNull())
    return present.select(F.col(id_col).alias("id"), canonical_key(df, exact, texts, lists).alias("k")).persist()


def copies(df: DataFrame, id_col: str, texts: list[str], lists: list[str], ignore: list[str] = (), required: list[str] = ()) -> DataFrame:
    """One row (first_id, n_copies) per distinct record, n_copies counting the representative itself."""
    keyed = _keyed(df, id_col, texts, lists, ignore, required)
    hot = F.broadcast(hot_keys(keyed, ["k"]).select("k"))
    rest = keyed.join(hot, "k", "left_anti").groupBy("k").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return rest.unionByName(_hot_totals(keyed, hot)).select("first_id", "n_copies")


def _hot_totals(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """(k, first_id, n_copies) of the hot keys, aggregated by (k, salt) and then by k."""
    salted = keyed.join(hot, "k", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = salted.groupBy("k", "salt").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return part.groupBy("k").agg(F.min("first_id").alias("first_id"), F.sum("n_copies").alias("n_copies"))


def copy_links(df: DataFrame, id_col: str, texts: list[str], lists: list[str], ignore: list[str] = (), required: list[str] = ()) -> DataFrame:
    """One row (first_id, row_id) for each record that is a copy of the record first_id.

    The rows of a key that isn't hot meet in one shuffle, where their smallest
    id is taken; a group is streamed, never held as a list. The rows of hot keys
    stay where they are and look up their representative in the totals, at most
    one row per hot key.
    """
    keyed = _keyed(df, id_col, texts, lists, ignore, required)
    hot = F.broadcast(hot_keys(keyed, ["k"]).select("k"))
    rest = keyed.join(hot, "k", "left_anti").select(F.min("id").over(W.partitionBy("k")).alias("first_id"), F.col("id").alias("row_id"))
    of_hot = keyed.join(F.broadcast(_hot_totals(keyed, hot)), "k").select("first_id", F.col("id").alias("row_id"))
    return rest.unionByName(of_hot).where("row_id <> first_id")
