"""Joins and aggregations that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of the rows, so that there are at most HOT_SHARE hot keys.
HOT_SHARE = 400
SALTS = 64
#: Slots in which keys are counted where there may be too many keys to count each.
SLOTS = 1 << 16
#: Rows of a key below which it is never cut.
BLOCK_ROWS = 4000


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE, least: int = 1000) -> DataFrame:
    """The hot keys and their exact counts (``n_rows``); at most ``share`` rows.

    Counting is a partial aggregation, so a hot key costs one record per map task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = df.count()
    return counts.where(F.col("n_rows") >= max(least, -(-total // share)))


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread_by: Column, how: str = "left", share: int = HOT_SHARE, hot: DataFrame | None = None) -> DataFrame:
    """Join ``left`` to ``right``, unique in ``key``, with the hot keys of ``left`` salted.

    ``hot`` names the hot keys, at most ``share`` rows, where they are known.

    Rows of a hot key are spread over SALTS reducers by ``spread_by``; only the
    hot rows of ``right`` (at most ``share``) are repeated, once per salt. Null
    keys match nothing and are kept by a left join.
    """
    if hot is None:
        hot = hot_keys(left.where(F.col(key).isNotNull()), [key], share)
    hot = F.broadcast(hot.select(F.col(key).alias("__hot")))
    salted = (
        left.join(hot, left[key] == F.col("__hot"), "left")
        .withColumn("__salt", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(F.lit(0)))
        .drop("__hot")
    )
    copies = (
        right.join(hot, right[key] == F.col("__hot"), "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        .withColumn("__salt", F.col("__salt").cast("bigint"))
        .drop("__hot")
    )
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def slot_of(keys: list[str]) -> Column:
    """A number below SLOTS that equal keys share."""
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def grid(left_counts: DataFrame, right_counts: DataFrame, least: int = BLOCK_ROWS, share: int = HOT_SHARE) -> DataFrame:
    """(slot, n_left, n_right): the blocks into which the rows of a hot slot are cut on each side; at most 2 x share rows.

    Both counts are (slot, n). A side of a slot is cut when it holds at least
    1/share of the side's rows and more than ``least`` rows.
    """
    both = left_counts.select("slot", F.col("n").alias("l")).join(right_counts.select("slot", F.col("n").alias("r")), "slot")
    size = lambda df: F.greatest(F.lit(least), F.ceil(df.agg(F.sum("n")).scalar() / share))
    blocks = both.select("slot", F.ceil(F.col("l") / size(left_counts)).cast("int").alias("n_left"), F.ceil(F.col("r") / size(right_counts)).cast("int").alias("n_right"))
    return blocks.where("n_left > 1 or n_right > 1")


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None = None, slot: Column | None = None, folded: bool = False) -> DataFrame:
    """Inner join of two sides of which neither is unique in the keys, with hot keys cut on both sides.

    Keys are counted by slot, so that the counts are at most SLOTS rows however
    many keys there are. The rows of a hot slot are cut into blocks by the hash
    of the row, n_left on one side and n_right on the other, and each block is
    repeated for the blocks of the other side: a reducer gets one pair of blocks.
    ``hot`` (see ``grid``) and ``slot`` can be given where they are known. With
    ``folded`` the one key is a 64-bit hash whose matches are checked later, and
    the numbers of the blocks are folded into it to keep the rows small.
    """
    slot = slot if slot is not None else slot_of(keys)
    if hot is None:
        counted = lambda df: df.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        hot = grid(counted(left), counted(right))
    hot = F.broadcast(hot.select(F.col("slot").alias("__slot"), F.col("n_left").alias("__nl"), F.col("n_right").alias("__nr")))

    def cut_up(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        placed = df.withColumns({"__s": slot, "__h": F.xxhash64(*df.columns)}).join(hot, F.col("__s") == F.col("__slot"), "left")
        own_n, other_n = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        return placed.withColumns({mine: F.pmod("__h", own_n).cast("int"), theirs: F.explode(F.sequence(F.lit(0), other_n - 1))}).drop("__s", "__h", "__slot", "__nl", "__nr")

    if folded:
        one = lambda df: df.withColumn(keys[0], F.when((F.col("__a") > 0) | (F.col("__b") > 0), F.xxhash64(keys[0], "__a", "__b")).otherwise(F.col(keys[0]))).drop("__a", "__b")
        return one(cut_up(left, "__nl", "__nr", "__a", "__b")).join(one(cut_up(right, "__nr", "__nl", "__b", "__a")), keys)
    return cut_up(left, "__nl", "__nr", "__a", "__b").join(cut_up(right, "__nr", "__nl", "__b", "__a"), [*keys, "__a", "__b"]).drop("__a", "__b")
