"""Cluster-aware resampling: bootstrap intervals, sign flips and permutations within clusters.

A statistic that is a mean, a rate or a ratio needs only one row per group and
cluster (sum and count), so the data are shuffled once and resampling works on
the cluster table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cluster_sums(df: DataFrame, groups: list[str], cluster: str, value: Column) -> DataFrame:
    """(groups, cluster, s, n): sum and count of the non-null values. Kept, as resampling reads it several times."""
    return df.withColumn("__v", value).where("__v is not null").groupBy(*groups, F.col(cluster).alias("cluster")).agg(F.sum("__v").alias("s"), F.count("__v").alias("n")).persist()


def hash_number(*parts: Column | str) -> Column:
    """32 bits of the MD5 of the parts; every engine gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


#: Clusters of a group that travel as one row, and clusters that a task of the bootstrap holds.
BLOCK, HELD = 1 << 16, 1 << 21
#: Draws that are hashed at once.
DRAWS = 1 << 14
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1)
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]


def _md5_heads(prefix: bytes, first: int, last: int) -> np.ndarray:
    """The first 32 bits of the MD5 of the prefix and each of the numbers from first to last - 1, all of as many digits, in one block."""
    digits = len(str(first))
    j = np.arange(first, last, dtype=np.int64)
    fixed = bytearray(prefix + b"\0" * digits + b"\x80").ljust(56, b"\0") + (8 * (len(prefix) + digits)).to_bytes(8, "little")
    words: list = [int.from_bytes(fixed[i : i + 4], "little") for i in range(0, 64, 4)]
    for i in range(digits):
        at = len(prefix) + i
        char = (j // 10 ** (digits - 1 - i) % 10 + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
        words[at // 4] = char + np.uint32(words[at // 4]) if isinstance(words[at // 4], int) else words[at // 4] + char
    a, b, c, d = (np.full(len(j), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        if isinstance(word, int):
            f += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_SINES[i])
        f += a
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=g)
        f <<= np.uint32(_TURNS[i])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(0x67452301)).byteswap()


def draw_numbers(seed: int, resample: int, first: int, last: int) -> np.ndarray:
    """hash_number of (seed, resample, j) for j from first to last - 1."""
    prefix, out = f"{seed}:{resample}:".encode(), np.empty(last - first, np.uint32)
    at = first
    while at < last:
        end = min(last, at + DRAWS, 10 ** len(str(at)))
        if end - at < 1000 or len(prefix) + len(str(at)) > 55:
            out[at - first : end - first] = [int.from_bytes(hashlib.md5(prefix + b"%d" % j).digest()[:4], "big") for j in range(at, end)]
        else:
            out[at - first : end - first] = _md5_heads(prefix, at, end)
        at = end
    return out


def _drawn(seed: int, resample: int, sizes: list[int]) -> dict[int, np.ndarray]:
    """How often each rank is drawn in a resample, for each number of clusters."""
    out = {c: np.zeros(c) for c in sizes}
    step = 64 * DRAWS
    for first in range(0, max(sizes, default=0), step):
        numbers = draw_numbers(seed, resample, first, min(max(sizes), first + step))
        for c in sizes:
            if c > first:
                out[c] += np.bincount(numbers[: c - first] % np.uint32(c), minlength=c)
    return out


def _resampled(table: pa.Table, groups: list[str], resamples: int, seed: int, block: int) -> pa.Table:
    """A row per group and resample of a unit: the sums over the clusters drawn, of those that the unit has."""
    part, parts = table["__p"][0].as_py(), table["__parts"][0].as_py()
    mine = range(resamples * part // parts, resamples * (part + 1) // parts)
    # blocks with the same ranks of groups of the same size are summed up together
    alike: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(zip(table["__c"].to_pylist(), table["__b"].to_pylist(), strict=True)):
        alike.setdefault(key, []).append(i)
    flat = lambda name, i: table[name][i].values.to_numpy(zero_copy_only=False)
    values = {key: np.stack([flat(name, i) for name in ("__s", "__n") for i in rows]) for key, rows in alike.items()}
    odd = {key: np.flatnonzero(~np.isfinite(v).all(axis=1)) for key, v in values.items()}
    sizes = sorted({c for c, _ in alike})
    s, n = (np.zeros((table.num_rows, len(mine))) for _ in range(2))
    for at, resample in enumerate(mine):
        drawn = _drawn(seed, resample, sizes)
        for key, rows in alike.items():
            times = drawn[key[0]][key[1] * block :][:block]
            got = values[key] @ times
            for i in odd[key]:  # 0 times what is no number is no number
                got[i] = (values[key][i][times > 0] * times[times > 0]).sum()
            s[rows, at], n[rows, at] = got[: len(rows)], got[len(rows) :]
    of = pa.array(np.repeat(np.arange(table.num_rows), len(mine)))
    return pa.table({**{g: table[g].take(of) for g in groups}, "__r": pa.array(np.tile(np.array(mine, np.int32), table.num_rows)), "s": pa.array(s.ravel()), "n": pa.array(n.ravel())})


def bootstrap_means(sums: DataFrame, groups: list[str], resamples: int, seed: int) -> DataFrame:
    """(groups, point, low, high): percentile interval of the mean over clusters drawn with replacement.

    Draw j of resample r takes the cluster whose rank in the group is the hash
    of (seed, r, j) modulo the number of clusters. Fewer than two clusters give
    a point without interval.

    The draws are never rows: a unit holds at most about HELD clusters of its groups
    as arrays in the order of the ranks, hashes its share of the resamples
    once for all of them and gives two sums a group and resample.
    """
    cores, block = sums.sparkSession.sparkContext.defaultParallelism, BLOCK
    counts = sums.groupBy(*groups).agg(F.count(F.lit(1)).alias("__c"), (F.sum("s") / F.sum("n")).alias("point"))
    ranked = sums.withColumn("__k", F.row_number().over(W.partitionBy(*groups).orderBy("cluster")) - 1)
    rows = ranked.groupBy(*groups, F.floor(F.col("__k") / block).cast("int").alias("__b")).agg(F.array_sort(F.collect_list(F.struct("__k", F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n")))).alias("__x"))
    blocks = counts.where("__c > 1").select(*groups, "__c", F.explode(F.sequence(F.lit(0), F.floor((F.col("__c") - 1) / block).cast("int"))).alias("__b"))
    size = F.least(F.lit(block), F.col("__c") - F.col("__b") * block)
    before = F.sum(size).over(W.orderBy("__c", "__b", *groups)) - size  # a row per group and block
    bins = blocks.withColumn("__bin", F.floor(before / HELD).cast("int")).withColumn("__parts", F.least(F.lit(resamples), F.ceil(cores / (F.max("__bin").over(W.partitionBy()) + 1))).cast("int"))
    unit = F.col("__bin") * F.col("__parts") + F.col("__p")
    placed = rows.join(bins, [*groups, "__b"]).select(*groups, "__c", "__b", "__bin", "__parts", F.col("__x.s").alias("__s"), F.col("__x.n").alias("__n"), F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__p")).withColumn("__unit", unit)
    schema = T.StructType([sums.schema[g] for g in groups]).add("__r", T.IntegerType()).add("s", T.DoubleType()).add("n", T.DoubleType())
    drawn = placed.repartitionById(cores, F.pmod("__unit", F.lit(cores))).groupBy("__unit").applyInArrow(lambda table: _resampled(table, groups, resamples, seed, block), schema)  # few bytes, much work
    means = drawn.groupBy(*groups, "__r").agg((F.sum("s") / F.sum("n")).alias("m"))
    ci = means.groupBy(*groups).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return counts.join(ci, groups, "left").select(*groups, "point", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def bootstrap_numpy(sums: pd.DataFrame, resamples: int, seed: int) -> tuple[float, float, float]:
    """Point and interval of one group's cluster table, drawn by numpy's generator in the order of sorted clusters."""
    table = sums.sort_values("cluster")
    s, n = table["s"].to_numpy(float), table["n"].to_numpy(float)
    point = s.sum() / n.sum() if n.sum() else float("nan")
    if len(s) < 2:
        return point, float("nan"), float("nan")
    rng = np.random.default_rng(seed)
    drawn = (rng.integers(0, len(s), len(s)) for _ in range(resamples))
    means = np.array([s[k].sum() / n[k].sum() for k in drawn])
    low, high = np.percentile(means, [2.5, 97.5])
    return point, float(low), float(high)


def bootstrap_metric(df: DataFrame, groups: list[str], cluster: str, metric: Callable[[pd.DataFrame], float], resamples: int, seed: int) -> DataFrame:
    """(groups, point, low, high) of any metric of a group's rows; for groups that fit into one task's memory."""
    columns = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster, kind="stable").reset_index(drop=True)
        parts = [at for at in pdf.groupby(cluster, sort=True).indices.values()]
        point = float(metric(pdf))
        low = high = float("nan")
        if len(parts) > 1:
            rng = np.random.default_rng(seed)
            got = [metric(pdf[columns].take(np.concatenate([parts[k] for k in rng.integers(0, len(parts), len(parts))]))) for _ in range(resamples)]
            low, high = np.nanpercentile(got, [2.5, 97.5])
        return pdf[groups].iloc[:1].assign(point=point, low=low, high=high)

    kinds = dict(df.dtypes)
    return df.groupBy(*groups).applyInPandas(run, ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "point double", "low double", "high double"]))


def sign_flip_exact(sums: DataFrame, groups: list[str], most: int = 16) -> DataFrame:
    """(groups, n_clusters, observed, p): the share of the 2^n sign patterns whose sum reaches the observed one.

    For at most ``most`` clusters a group; others have a null p. All sums zero
    gives 1, fewer than two clusters null.
    """
    per = sums.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("s").alias("observed"), F.sum(F.abs("s")).alias("size"))
    few = per.where(f"n_clusters between 2 and {most} and size > 0")
    lists = sums.join(few, groups).groupBy(*groups, "n_clusters", "observed", "size").agg(F.array_sort(F.collect_list(F.struct("cluster", "s"))).alias("c"))  # at most ``most`` clusters
    flips = lists.withColumn("v", F.col("c.s")).withColumn("mask", F.explode(F.expr("sequence(0L, shiftleft(1L, cast(n_clusters as int)) - 1)")))
    null = F.expr("aggregate(sequence(0, cast(n_clusters as int) - 1), 0D, (a, i) -> a + if((shiftright(mask, i) & 1L) = 1, -v[i], v[i]))")
    shares = flips.withColumn("hit", (null >= F.col("observed") - 1e-12 * F.greatest(F.lit(1.0), F.col("size"))).cast("double")).groupBy(*groups).agg(F.avg("hit").alias("share"))
    p = F.when((F.col("n_clusters") >= 2) & (F.col("size") == 0), F.lit(1.0)).otherwise(F.col("share"))
    return per.join(shares, groups, "left").select(*groups, "n_clusters", "observed", p.alias("p"))


def bootstrap_poisson(sums: DataFrame, groups: list[str], resamples: int, seed: int) -> DataFrame:
    """(groups, n_clusters, point, low, high): percentile interval of the mean where each cluster is drawn a Poisson number of times.

    For any number of clusters: the draws of a cluster come from a generator
    seeded by its hash, tasks add up their own clusters, and one array pair per
    task and group is shuffled.
    """
    kinds = dict(sums.dtypes)
    keyed = sums.select(*groups, F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n"), F.xxhash64(F.lit(seed), F.col("cluster").cast("string")).alias("h"))
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "bs array<double>", "bn array<double>", "s double", "n double", "c bigint"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                times = np.random.default_rng(row.h & 0xFFFFFFFFFFFFFFFF).poisson(1.0, resamples)
                acc = held.setdefault(tuple(getattr(row, g) for g in groups), [np.zeros(resamples), np.zeros(resamples), 0.0, 0.0, 0])
                acc[0] += times * row.s
                acc[1] += times * row.n
                acc[2], acc[3], acc[4] = acc[2] + row.s, acc[3] + row.n, acc[4] + 1
        for key, (bs, bn, s, n, c) in held.items():
            yield pd.DataFrame({**dict(zip(groups, ([k] for k in key), strict=True)), "bs": [bs], "bn": [bn], "s": [s], "n": [n], "c": [c]})

    parts = keyed.mapInPandas(partial, schema).persist()
    totals = parts.groupBy(*groups).agg(F.sum("c").alias("n_clusters"), (F.sum("s") / F.sum("n")).alias("point"))
    reps = parts.select(*groups, F.posexplode(F.arrays_zip("bs", "bn")).alias("rep", "x")).groupBy(*groups, "rep").agg(F.sum("x.bs").alias("bs"), F.sum("x.bn").alias("bn")).where("bn > 0")
    ci = reps.groupBy(*groups).agg(F.percentile(F.col("bs") / F.col("bn"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    end = lambda i: F.when(F.col("n_clusters") > 1, F.get("q", F.lit(i)))
    return totals.join(ci, groups, "left").select(*groups, "n_clusters", "point", end(0).alias("low"), end(1).alias("high"))


#: Clusters whose signs are made at once, and groups that are summed up at once.
SIGNED, SUMMED = 256, 64


def _flipped(batches: Iterator[pa.RecordBatch], groups: list[str], permutations: int) -> Iterator[pa.RecordBatch]:
    """A row per group: its null sums, and sum, sum of sizes and number of its clusters; the signs of a cluster are made once for all groups of a batch."""
    held: dict[tuple, list] = {}
    signs, kinds = np.empty((SIGNED, permutations)), []
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = [batch.schema.field(g).type for g in groups]
        _, first, code = np.unique(batch.select(groups).to_pandas().groupby(groups, dropna=False, sort=False).ngroup(), return_index=True, return_inverse=True)
        keys = list(zip(*(batch.column(g).take(pa.array(first)).to_pylist() for g in groups), strict=True))
        mine = [held.setdefault(key, [np.zeros(permutations), 0.0, 0.0, 0]) for key in keys]
        s = batch.column("s").to_numpy(zero_copy_only=False)
        for acc, x, size, n in zip(mine, *(np.bincount(code, w, len(mine)) for w in (s, np.abs(s), None)), strict=True):
            acc[1], acc[2], acc[3] = acc[1] + x, acc[2] + size, acc[3] + int(n)
        hashes, at = np.unique(batch.column("__h").to_numpy().view(np.uint64), return_inverse=True)
        for a in range(0, len(hashes), SIGNED):
            part = hashes[a : a + SIGNED]
            for i, h in enumerate(part):
                signs[i] = np.random.default_rng(int(h)).integers(0, 2, permutations, dtype=np.int8)
            rows = np.flatnonzero((at >= a) & (at < a + SIGNED))
            sums = np.zeros((len(mine), len(part)))
            np.add.at(sums, (code[rows], at[rows] - a), s[rows])
            np.subtract(2 * signs[: len(part)], 1, out=signs[: len(part)])
            for b in range(0, len(mine), SUMMED):
                for acc, x in zip(mine[b : b + SUMMED], sums[b : b + SUMMED] @ signs[: len(part)], strict=True):
                    acc[0] += x
    if held:
        flat = np.concatenate([acc[0] for acc in held.values()])
        null = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * permutations), pa.array(flat))
        yield pa.RecordBatch.from_pydict({
            **{g: pa.array([key[i] for key in held], kinds[i]) for i, g in enumerate(groups)}, "null": null,
            **{name: pa.array([acc[i] for acc in held.values()], kind) for i, (name, kind) in enumerate((("observed", pa.float64()), ("size", pa.float64()), ("n_clusters", pa.int64())), 1)},
        })


def _flip_p(table: pa.Table, groups: list[str], permutations: int) -> pa.Table:
    """The p of a group from what the tasks have of it; as in Spark, no number is above what is no number."""
    null = sum(x.values.to_numpy() for x in table["null"])
    observed, size, n = (table[c].to_numpy().sum() for c in ("observed", "size", "n_clusters"))
    hits = int((np.isnan(null) | (null >= observed - 1e-12 * np.maximum(1.0, size))).sum())
    p = None if n < 2 else 1.0 if size == 0 else (1 + hits) / (permutations + 1)
    return pa.table({**{g: table[g].slice(0, 1) for g in groups}, "n_clusters": pa.array([int(n)]), "observed": pa.array([float(observed)]), "p": pa.array([p], pa.float64())})


def sign_flip_sampled(sums: DataFrame, groups: list[str], permutations: int, seed: int) -> DataFrame:
    """(groups, n_clusters, observed, p): the sampled sign flip, p = (1 + hits) / (permutations + 1).

    The signs of a cluster come from a generator seeded by its hash. Clusters
    are shuffled by that hash, so the signs are made once for all groups, and a
    task adds up the null sums of its clusters; one array per task and group is
    shuffled, there being as many tasks as cores.
    """
    keyed = sums.select(*groups, F.col("s").cast("double").alias("s"), F.xxhash64(F.lit(seed), F.col("cluster").cast("string")).alias("__h"))
    by_hash = keyed.repartition(sums.sparkSession.sparkContext.defaultParallelism, "__h").sortWithinPartitions("__h")
    keys = T.StructType([sums.schema[g] for g in groups])
    number = lambda schema: schema.add("observed", T.DoubleType())
    parts = by_hash.mapInArrow(lambda batches: _flipped(batches, groups, permutations), number(T.StructType([*keys]).add("null", T.ArrayType(T.DoubleType()))).add("size", T.DoubleType()).add("n_clusters", T.LongType()))
    return parts.groupBy(*groups).applyInArrow(lambda table: _flip_p(table, groups, permutations), number(T.StructType([*keys]).add("n_clusters", T.LongType())).add("p", T.DoubleType()))


def within_cluster_permutation(df: DataFrame, groups: list[str], cluster: str, row: str, left: Column, right: Column, permutations: int, seed: int, plus_one: bool = True) -> DataFrame:
    """(groups, observed, null_mean, p) of the mean of left x right agreement when right is permuted among the rows of a cluster.

    ``left`` and ``right`` are signs; the statistic is the share of rows where
    they are equal, over rows whose left sign isn't 0. A permutation orders the
    rows of a cluster by the hash of (seed, permutation, row): the k-th row by
    that order gives its right sign to the k-th row of the cluster.
    """
    rows = df.select(*groups, F.col(cluster).alias("c"), F.col(row).alias("row"), left.alias("l"), right.alias("r"))
    own = rows.withColumn("k", F.row_number().over(W.partitionBy(*groups, "c").orderBy("row")))
    observed = own.where("l <> 0").groupBy(*groups).agg(F.avg((F.col("l") == F.col("r")).cast("double")).alias("observed"))
    order = hash_number(F.lit(str(seed)), F.col("rep").cast("string"), F.col("row").cast("string"))
    # rows x permutations, each row once a permutation
    mixed = own.select(*groups, "c", "row", "r").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn("k", F.row_number().over(W.partitionBy(*groups, "c", "rep").orderBy(order, "row"))).drop("row")
    null = own.where("l <> 0").select(*groups, "c", "k", "l").join(mixed, [*groups, "c", "k"]).groupBy(*groups, "rep").agg(F.avg((F.col("l") == F.col("r")).cast("double")).alias("x"))
    hits = null.join(observed, groups).groupBy(*groups).agg(F.first("observed").alias("observed"), F.avg("x").alias("null_mean"), F.count_if(F.col("x") >= F.col("observed") - 1e-12).alias("hits"))
    p = (1 + F.col("hits")) / (permutations + 1) if plus_one else F.col("hits") / permutations
    return hits.select(*groups, "observed", "null_mean", p.alias("p"))


def within_cluster_permutation_counts(df: DataFrame, groups: list[str], cluster: str, left: Column, right: Column, permutations: int, seed: int) -> DataFrame:
    """(groups, observed, null_mean, p) of the statistic of within_cluster_permutation, for many permutations.

    Agreement depends only on how many right signs of each kind fall to the rows
    of each left sign, which is hypergeometric within a cluster. So a cluster is
    one row of counts whose permutations are drawn as counts by a generator
    seeded by its hash; one array a task and group is shuffled.
    """
    kinds = dict(df.dtypes)
    signs = df.select(*groups, F.col(cluster).cast("string").alias("c"), left.alias("l"), right.alias("r"))
    number = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    counts = signs.groupBy(*groups, "c").agg(
        number(F.col("l") > 0, "up"), number(F.col("l") < 0, "down"), number(F.col("r") > 0, "rup"), number(F.col("r") < 0, "rdown"),
        F.count(F.lit(1)).alias("n"), number((F.col("l") != 0) & (F.col("l") == F.col("r")), "same"),
    )
    keyed = counts.where("up + down > 0").withColumn("h", F.xxhash64(F.lit(seed), "c")).drop("c")
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "null array<bigint>", "same bigint", "moved bigint"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                rng = np.random.default_rng(row.h & 0xFFFFFFFFFFFFFFFF)
                acc = held.setdefault(tuple(getattr(row, g) for g in groups), [np.zeros(permutations, np.int64), 0, 0])
                # right signs that fall to the rows of left sign 1, then those of the rest that fall to left sign -1
                ups = rng.hypergeometric(row.rup, row.n - row.rup, row.up, permutations)
                downs = rng.hypergeometric(row.rdown, row.n - row.rup - row.rdown, row.up - ups)
                acc[0] += ups + rng.hypergeometric(row.rdown - downs, row.n - row.up - (row.rdown - downs), row.down)
                acc[1], acc[2] = acc[1] + row.same, acc[2] + row.up + row.down
        for key, (null, same, moved) in held.items():
            yield pd.DataFrame({**dict(zip(groups, ([k] for k in key), strict=True)), "null": [null], "same": [same], "moved": [moved]})

    parts = keyed.mapInPandas(partial, schema).persist()
    totals = parts.groupBy(*groups).agg(F.sum("same").alias("same"), F.sum("moved").alias("moved"))
    nulls = parts.select(*groups, F.posexplode("null").alias("rep", "x")).groupBy(*groups, "rep").agg(F.sum("x").alias("x"))
    hits = nulls.join(totals, groups).groupBy(*groups).agg(F.first("same").alias("same"), F.first("moved").alias("moved"), F.avg("x").alias("x"), F.count_if(F.col("x") >= F.col("same")).alias("hits"))
    return hits.select(*groups, (F.col("same") / F.col("moved")).alias("observed"), (F.col("x") / F.col("moved")).alias("null_mean"), ((1 + F.col("hits")) / (permutations + 1)).alias("p"))


def correlation_permutation(x: np.ndarray, y: np.ndarray, permutations: int, seed: int, ranks: bool = False) -> float:
    """The share of permutations of y whose correlation with x reaches the observed one; for a few points (categories)."""
    if ranks:
        x, y = (pd.Series(v).rank().to_numpy() for v in (x, y))
    rng = np.random.default_rng(seed)
    observed = np.corrcoef(x, y)[0, 1]
    return float(np.mean([np.corrcoef(x, rng.permutation(y))[0, 1] >= observed for _ in range(permutations)]))
