"""Splits that keep related records together.

Rows are tied by usable ids of several kinds (patient, author, source). The ids
are the nodes of a graph, an edge for each pair of ids that some row has. Its
components are found by breadth-first search from many seeds at once:

1. seeds are the nodes whose hash is smaller than that of all neighbours, so
   every component has one;
2. all seeds expand together: the adjacency lists are hash-partitioned once by
   node, the list of a node with very many neighbours being cut in SALTS parts,
   and only the nodes that were reached last meet them in each of HOPS steps; a
   node takes the smallest seed of those that reach it first, and one that none
   reaches is its own seed;
3. edges between nodes of different seeds are collisions: they make a graph of
   seeds, far smaller. While it has more than SMALL_GRAPH edges the same is done
   on it; then its seeds are merged in one task. The root of a component is its
   smallest node either way.

Components are then put into the splits in hash order, by cumulated row counts.
Components of at least 1/LARGE of all rows, of which there are at most LARGE,
are placed first, each where most room is left: in hash order one of a third of
the rows would fall on a small split as a whole.

A row without usable id is a component of its own. Null ids, words that name
nobody (ids without digits) and blank ids tie nothing. Empty tables give empty
results. A repeated row is tied to itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.plans.skew import SALTS, hot_keys, salted_lookup
from tidewright.session import cut

#: A number in an id; a decimal zero doesn't count.
ID_NUMBER = r"([0-9]+)(?:\.0+(?![0-9]))?"
LARGE = 100
HOPS = 2
#: Edges that one task merges; a graph of more is searched again.
SMALL_GRAPH = 200_000
BUCKETS = 1024


def id_number(column: Column) -> Column:
    """The numbers in an id without leading zeros, joined by a hyphen; null when the id names nobody."""
    found = F.regexp_extract_all(column.cast("string"), F.lit(ID_NUMBER), F.lit(1))
    return F.nullif(F.array_join(F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")), "-"), F.lit(""))


def ties(df: DataFrame, row_col: str, id_cols: list[str], normal: Callable[[Column], Column] = id_number) -> DataFrame:
    """(row_id, nodes): the usable ids of each row as nodes ``kind:number``, in the order of id_cols.

    ``normal`` turns an id into the text that equal ids share, null for one that
    ties nothing.
    """
    nodes = [F.concat(F.lit(f"{i}:"), normal(F.col(c))) for i, c in enumerate(id_cols)]
    return df.select(F.col(row_col).alias("row_id"), F.array_compact(F.array(*nodes)).alias("nodes"))


def tie_edges(tied: DataFrame) -> DataFrame:
    """The distinct edges (a, b) between the ids of a row; each row's ids are chained, which ties all of them."""
    pairs = F.expr("transform(sequence(1, size(nodes) - 1), i -> struct(least(nodes[i - 1], nodes[i]) as a, greatest(nodes[i - 1], nodes[i]) as b))")
    return tied.where(F.size("nodes") > 1).select(F.inline(pairs)).where("a <> b").distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    """The adjacency list of distinct edges."""
    return edges.selectExpr("inline(array(named_struct('src', a, 'dst', b), named_struct('src', b, 'dst', a)))")


def _seeded(edges: DataFrame) -> DataFrame:
    """(node, seed) for every node: breadth-first search of HOPS steps from all seeds at once."""
    both = _both_ways(edges)
    hot = F.broadcast(hot_keys(both, ["src"]).select(F.col("src").alias("hub")))
    salted = both.join(hot, F.col("src") == F.col("hub"), "left").withColumn("salt", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("dst"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    adjacent = salted.select("src", "salt", "dst").repartition("src", "salt").persist()
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    least = adjacent.groupBy("src").agg(F.min(rank("dst")).alias("around"))
    is_seed = rank("src") < F.col("around")
    labels = least.select(F.col("src").alias("node"), F.when(is_seed, F.col("src")).alias("seed"), F.when(is_seed, 0).alias("step"))
    for step in range(1, HOPS + 1):
        last = labels.where(F.col("step") == step - 1).join(hot, F.col("node") == F.col("hub"), "left")
        parts = F.when(F.col("hub").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        frontier = last.select(F.col("node").alias("src"), F.explode(parts).alias("salt"), "seed")
        reached = adjacent.join(frontier, ["src", "salt"]).groupBy(F.col("dst").alias("node")).agg(F.min("seed").alias("met"))
        labels = labels.join(reached, "node", "left").select("node", F.coalesce("seed", "met").alias("seed"), F.coalesce("step", F.when(F.col("met").isNotNull(), step)).alias("step"))
    done = cut(labels.select("node", F.coalesce("seed", "node").alias("seed")))
    adjacent.unpersist()
    return done


def _merged(edges: DataFrame) -> DataFrame:
    """(node, seed) of a small graph, merged in one task; the seed is the smallest node of the component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[str, str] = {}

        def find(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pd.DataFrame({"node": nodes, "seed": [find(x) for x in nodes]}, dtype=object)

    return edges.coalesce(1).mapInPandas(run, "node string, seed string")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is one node of the component."""
    maps: list[DataFrame] = []
    edges = cut(edges)
    while (n := edges.count()) > 0:
        if maps and n <= SMALL_GRAPH:
            maps.append(cut(_merged(edges)))
            break
        seeds = _seeded(edges)
        maps.append(seeds)
        of = lambda end: seeds.select(F.col("node").alias(end), F.col("seed").alias(f"seed_{end}"))
        met = edges.join(of("a"), "a").join(of("b"), "b").where("seed_a <> seed_b")
        edges = cut(met.select(F.least("seed_a", "seed_b").alias("a"), F.greatest("seed_a", "seed_b").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("node", F.col("seed").alias("root"))
    for lower in reversed(maps[:-1]):
        up = roots.select(F.col("node").alias("seed"), "root")
        roots = lower.join(up, "seed", "left").select("node", F.coalesce("root", "seed").alias("root"))
    return roots


def grouped(df: DataFrame, row_col: str, id_cols: list[str], normal: Callable[[Column], Column] = id_number) -> DataFrame:
    """(row_id, root, group_no) of every row; root null when no id is usable.

    root is the smallest node of the group, group_no the smallest number of the
    first id column in it, null when it has none.
    """
    tied = cut(ties(df, row_col, id_cols, normal))  # ids alone
    roots = components(tie_edges(tied))
    alone = tied.where(F.size("nodes") == 1).select(F.col("nodes")[0].alias("node")).distinct()
    nodes = alone.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")).unionByName(roots)
    number = F.when(F.startswith("node", F.lit("0:")), F.expr("try_cast(substring(node, 3) as bigint)"))
    least = nodes.groupBy("root").agg(F.min("node").alias("first"), F.min(number).alias("group_no"))
    named = cut(salted_lookup(nodes, least, "root", F.col("node")).select("node", F.col("first").alias("root"), "group_no"))
    rows = tied.select("row_id", F.get("nodes", F.lit(0)).alias("node"))
    return salted_lookup(rows, named, "node", F.col("row_id")).select("row_id", "root", "group_no")


def assign_splits(groups: DataFrame, shares: dict[str, float], seed: int = 17) -> DataFrame:
    """(row_id, split, root, group_no): the groups of ``grouped`` put into splits near the given shares."""
    groups = cut(groups)  # three columns
    spread_hash = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), c), 12).cast("double") / F.lit(float(2**52))
    names = list(shares)
    edges = [sum(shares[n] for n in names[: i + 1]) / sum(shares.values()) for i in range(len(names))]

    def at(position: Column, ends: list[float]) -> Column:
        out = F.lit(names[-1])
        for name, end in reversed(list(zip(names[:-1], ends, strict=False))):
            out = F.when(position < F.lit(end), F.lit(name)).otherwise(out)
        return out

    alone = groups.where("root is null").select("row_id", at(spread_hash(F.col("row_id")), edges).alias("split"), "root", "group_no")
    sizes = cut(groups.where("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("h", spread_hash(F.col("root"))))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    room = {n: shares[n] / sum(shares.values()) * total for n in names}
    large = sizes.where(F.col("n") * LARGE >= F.lit(max(total, 1))).orderBy(F.desc("n"), "root").select("root", "n").collect()  # at most LARGE rows
    placed = []
    for root, n in large:
        name = max(names, key=lambda x: room[x])
        room[name] -= n
        placed.append((root, name))
    small = sizes.join(F.broadcast(sizes.sparkSession.createDataFrame(placed, "root string, split string").select("root")), "root", "left_anti")
    left = {n: max(r, 0.0) for n, r in room.items()}
    whole = sum(left.values()) or 1.0
    ends = [sum(left[n] for n in names[: i + 1]) / whole for i in range(len(names))]
    # positions in hash order: offsets of hash buckets, then cumulated sizes inside a bucket
    small = small.withColumn("bucket", F.floor(F.col("h") * BUCKETS))
    buckets = small.groupBy("bucket").agg(F.sum("n").alias("m"))
    before = buckets.select("bucket", (F.sum("m").over(W.orderBy("bucket")) - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy()).alias("all"))  # BUCKETS rows
    inside = W.partitionBy("bucket").orderBy("h", "root").rowsBetween(W.unboundedPreceding, 0)
    middle = (F.col("before") + F.sum("n").over(inside) - F.col("n") / 2) / F.col("all")
    chosen = small.join(F.broadcast(before), "bucket").select("root", at(middle, ends).alias("split"))
    chosen = chosen.unionByName(sizes.sparkSession.createDataFrame(placed, "root string, split string"))
    tied = salted_lookup(groups.where("root is not null"), chosen, "root", F.col("row_id"))
    return tied.select("row_id", "split", "root", "group_no").unionByName(alone)


def split_report(assigned: DataFrame) -> DataFrame:
    """One row per split: rows, groups (a row without usable id is one) and the share of all rows."""
    group = F.coalesce("root", F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    per = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"))
    return per.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(W.partitionBy()))
