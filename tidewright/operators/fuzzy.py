"""Blocked fuzzy clustering and matching of item names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.text import fold, folded_ascii, trimmed, words
from tidewright.session import cut, cut_in_loop

BLOCK_CAP = 200
TOKEN_SHARE = 0.25
#: Forms that are broadcast together.
FORM_BLOCK = 20_000


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the second text."""
    where: dict[str, int] = {}
    for i, char in enumerate(b):
        where[char] = where.get(char, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for char in a:
        hit = row & where.get(char, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 x twice the common subsequence by both lengths; 100 for two empty texts."""
    return 100.0 * 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def similarity(a: str, b: str) -> float:
    """0.65 x the ratio of the texts with sorted words and 0.35 x that of the texts, from 0 to 1."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    sort = lambda t: " ".join(sorted(t.split()))
    return (0.65 * ratio(sort(a), sort(b)) + 0.35 * ratio(a, b)) / 100


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _marks(text: str) -> tuple[int, int]:
    """128 bits in two numbers: one for each character and its how-manieth it is; several may share a bit."""
    bits, seen = 0, {}
    for char in text:
        k = seen[char] = seen.get(char, 0) + 1
        bits |= 1 << ((ord(char) * 0x9E3779B1 + k * 0x85EBCA6B & 0xFFFFFFFF) >> 25)
    return tuple(x - (x >> 63 << 64) for x in (bits & (1 << 64) - 1, bits >> 64))


@F.pandas_udf(T.StructType().add("m1", T.LongType()).add("m2", T.LongType()))
def marks_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_marks(t or "") for t in texts], columns=["m1", "m2"], dtype="int64")


def distinct_items(rows: DataFrame, item: str) -> DataFrame:
    """(id, original, norm): the distinct trimmed items whose normal form isn't empty; id orders them by text."""
    items = rows.select(trimmed(F.col(item)).alias("original")).where("original is not null").distinct().withColumn("norm", folded_ascii(F.col("original")))
    return items.where("norm <> ''").select(F.xxhash64("original").alias("id"), "original", "norm")


def stop_tokens(items: DataFrame, share: float = TOKEN_SHARE) -> DataFrame:
    """Words of more than max(2, share of all items) items."""
    total = items.agg(F.count(F.lit(1)).alias("__n"))
    counts = items.select("id", F.explode(F.array_distinct(words(F.col("norm")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return counts.where(F.col("df") > F.greatest(F.lit(2), F.ceil(share * total.scalar()))).select("token", "df")


def block_keys(items: DataFrame) -> DataFrame:
    """(id, key): prefix, length class, words of three letters and more, first word, first sorted word, letter triples.

    Words that are stop tokens make no key.
    """
    norm, tokens = F.col("norm"), words(F.col("norm"))
    packed = F.replace(norm, F.lit(" "), F.lit(""))
    triples = F.when(F.length(packed) >= 3, F.transform(F.sequence(F.lit(1), F.length(packed) - 2), lambda i: F.concat(F.lit("g:"), F.substring(packed, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    tag = lambda t, c: F.concat(F.lit(f"{t}:"), c)
    fixed = F.array(tag("p", F.substring(norm, 1, 3)), tag("l", F.floor(F.length(norm) / 5).cast("string")), tag("f", F.get(tokens, F.lit(0))), tag("s", F.get(F.array_sort(tokens), F.lit(0))))
    plain = items.select("id", F.explode(F.array_compact(F.array_union(fixed, triples))).alias("key"))
    worded = items.select("id", F.explode(F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 3))).alias("token")).join(stop_tokens(items), "token", "left_anti")
    return plain.unionByName(worded.select("id", tag("t", F.col("token")).alias("key")))


def candidate_pairs(items: DataFrame, cap: int = BLOCK_CAP, traits: DataFrame | None = None, near: str = "true") -> DataFrame:
    """Distinct (a, b), a < b, that share a block of at most ``cap`` items; larger blocks are left out, as their rule says.

    ``near`` is a condition on the traits of both, a row for each id, named with _a and _b.
    """
    keys = block_keys(items).distinct()
    blocks = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, cap)).select("key")
    small = keys.join(blocks, "key")
    small = small if traits is None else small.join(traits, "id")
    side = lambda n: small.select("key", F.col("id").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in small.columns if c not in ("key", "id")))
    return side("a").join(side("b"), "key").where("a < b").where(near).select("a", "b").distinct()


def similar_edges(items: DataFrame, threshold: float, cap: int = BLOCK_CAP) -> DataFrame:
    """Candidate pairs whose similarity reaches the threshold, or three quarters of it when one contains the other."""
    threshold = threshold / 100 if threshold > 1 else threshold
    side = lambda n: items.select(F.col("id").alias(n), F.col("norm").alias(f"norm_{n}"))
    # a bit of one text only is a character that isn't common; a text inside the other has none of its own
    traits = items.select("id", F.length("norm").alias("n"), marks_udf("norm").alias("m")).select("id", "n", "m.*")
    alone = lambda x, y: f"(bit_count(m1_{x} & ~m1_{y}) + bit_count(m2_{x} & ~m2_{y}))"
    common = f"least(n_a - {alone('a', 'b')}, n_b - {alone('b', 'a')})"
    near = f"2D * {common} >= (n_a + n_b) * (if({alone('a', 'b')} = 0 or {alone('b', 'a')} = 0, {0.75 * threshold!r}D, {threshold!r}D) - 1e-9D)"
    pairs = candidate_pairs(items, cap, traits, near).join(side("a"), "a").join(side("b"), "b")
    inside = F.contains("norm_a", F.col("norm_b")) | F.contains("norm_b", F.col("norm_a"))
    needed = F.when(inside, 0.75 * threshold).otherwise(threshold)
    # no ratio exceeds twice the shorter length by both lengths, so most pairs need no Python
    most = 2 * F.least(F.length("norm_a"), F.length("norm_b")) / (F.length("norm_a") + F.length("norm_b"))
    scored = pairs.where(most >= needed - 1e-9).withColumns({"need": needed, "sim": similarity_udf("norm_a", "norm_b")})
    return scored.where("sim >= need").select("a", "b", "sim")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each component.

    Labels spread to neighbours and then jump to the label of the label, so
    paths shorten; a round is two joins, cut from its lineage.
    """
    both = cut_in_loop(edges.selectExpr(f"inline(array(named_struct('u', `{a}`, 'v', `{b}`), named_struct('u', `{b}`, 'v', `{a}`)))").distinct())
    labels = cut_in_loop(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        hopped = labels.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = cut_in_loop(hopped.join(up, "component", "left").select("node", F.least("component", F.coalesce("top", "component")).alias("component"), "old"))
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def item_clusters(rows: DataFrame, item: str, threshold: float = 85, singletons: bool = False) -> DataFrame:
    """(original, cluster, representative): similar items under their longest form; ties by normal form and text."""
    items = cut(distinct_items(rows, item))
    found = connected_components(similar_edges(items, threshold))
    joined = items.join(found, items["id"] == found["node"], "left" if singletons else "inner").withColumn("cluster", F.coalesce("component", "id"))
    best = joined.groupBy("cluster").agg(F.min_by("original", F.struct(-F.length("original"), "norm", "original")).alias("representative"), F.count(F.lit(1)).alias("n_forms"))
    return joined.select("original", "cluster").join(best, "cluster")


def exact_mapping(rows: DataFrame, text: str, mapping: DataFrame, canonical: str = "canonical_item", variants: str = "variants") -> DataFrame:
    """The rows with their canonical item (case and outer blanks aside) and whether it is resolved; unresolved keep their trimmed text."""
    forms = mapping_forms(mapping, canonical, variants)
    key = F.lower(trimmed(F.col(text)))
    return rows.withColumn("__key", key).join(forms.select(F.col("form").alias("__key"), "canonical"), "__key", "left").withColumns({"resolved": F.col("canonical").isNotNull(), "standard": F.coalesce("canonical", trimmed(F.col(text)))}).drop("__key", "canonical")


def mapping_forms(mapping: DataFrame, canonical: str = "canonical_item", variants: str = "variants") -> DataFrame:
    """(form, canonical): one row per normalised canonical item or variant; of a form of two items the smaller item holds."""
    forms = mapping.select(F.col(canonical).alias("canonical"), F.explode(F.concat(F.array(canonical), F.coalesce(variants, F.array().cast("array<string>")))).alias("form"))
    return forms.select(F.lower(trimmed(F.col("form"))).alias("form"), trimmed(F.col("canonical")).alias("canonical")).where("form <> ''").groupBy("form").agg(F.min("canonical").alias("canonical"))


def mapping_conflicts(mapping: DataFrame, canonical: str = "canonical_item", variants: str = "variants") -> DataFrame:
    """Forms that stand for several canonical items."""
    forms = mapping.select(F.col(canonical).alias("canonical"), F.explode(F.coalesce(variants, F.array().cast("array<string>"))).alias("form"))
    return forms.select(F.lower(trimmed(F.col("form"))).alias("form"), F.lower(trimmed(F.col("canonical"))).alias("canonical")).groupBy("form").agg(F.count_distinct("canonical").alias("n_items")).where("n_items > 1")


class Forms:
    """Forms (normal form, form, canonical) to which texts are compared, all of them by a bound and the nearest by their similarity.

    Two texts can have no longer common subsequence than characters in common,
    so forms are compared in the order of that bound until it can't reach the
    best similarity; the result is that of comparing with every form.
    """

    BINS = 96

    def __init__(self, forms: list[tuple[str, str, str | None]]):
        self.forms = forms
        sort = [" ".join(sorted(f.split())) for f, _, _ in forms]
        self.lengths = np.array([len(f) for f, _, _ in forms], np.int64)
        self.sorted_lengths = np.array([len(f) for f in sort], np.int64)
        self.counts = np.array([self._count(f) for f, _, _ in forms], np.int32).reshape(len(forms), self.BINS)

    def _count(self, text: str) -> np.ndarray:
        return np.bincount([ord(c) % self.BINS for c in text], minlength=self.BINS) if text else np.zeros(self.BINS, np.int64)

    def best(self, text: str) -> tuple[float, str | None, str | None]:
        """(similarity, form, canonical) of the nearest form, the first by name among equals; no form for an empty list or text."""
        if not text or not self.forms:
            return 0.0, None, None
        common = 2.0 * np.minimum(self.counts, self._count(text)).sum(axis=1)
        own = len(" ".join(text.split()))
        bound = 0.65 * np.minimum(1, common / (self.sorted_lengths + own)) + 0.35 * np.minimum(1, common / (self.lengths + len(text)))
        best: tuple[float, str | None, str | None] = (0.0, None, None)
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < best[0] - 1e-12:
                break
            norm, form, canonical = self.forms[i]
            score = similarity(text, norm)
            if best[1] is None or (-score, form) < (-best[0], best[1]):
                best = (score, form, canonical)
        return best


class FuzzyMatcher:
    """The nearest known form of a text, fitted on training forms only; ties go to the first form."""

    def __init__(self, forms: list[tuple[str, str]], threshold: float = 85):
        self.forms = Forms([(fold(f), f"{i:09d}", c) for i, (f, c) in enumerate(forms)])
        self.threshold = threshold / 100 if threshold > 1 else threshold

    def match(self, text: str) -> tuple[str | None, float]:
        score, _, canonical = self.forms.best(fold(text))
        return (canonical if score >= self.threshold else None), score


def fuzzy_fallback(rows: DataFrame, text: str, key: str, forms: DataFrame, threshold: float = 85, block: int = FORM_BLOCK) -> DataFrame:
    """(key, text, match, score): the nearest of all forms of each unresolved text, null below the threshold.

    Distinct texts are compared once. The forms are broadcast in blocks of a
    fixed size; the block changes no result.
    """
    threshold = threshold / 100 if threshold > 1 else threshold
    context = rows.sparkSession.sparkContext
    texts = rows.where(F.col(text).isNotNull() & (trimmed(F.col(text)) != "")).select(key, trimmed(F.col(text)).alias("text"))
    queries = texts.select("text").distinct().select("text", folded_ascii(F.col("text")).alias("norm")).where("norm <> ''")
    queries = queries.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    blocks, held = [], []
    for row in forms.select(folded_ascii(F.col("form")).alias("norm"), "form", "canonical").where("norm <> ''").distinct().toLocalIterator():  # one block at a time
        held.append(tuple(row))
        if len(held) == block:
            blocks.append(context.broadcast(held))
            held = []
    if held:
        blocks.append(context.broadcast(held))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, Forms] = {}
        for pdf in batches:
            best: list[tuple] = [(0.0, None, None)] * len(pdf)
            for i, part in enumerate(blocks):
                if i not in made:
                    made = {i: Forms(part.value)}  # one block at a time
                for j, norm in enumerate(pdf["norm"]):
                    found = made[i].best(norm)
                    if found[1] is not None and (best[j][1] is None or (-found[0], found[1]) < (-best[j][0], best[j][1])):
                        best[j] = found
            yield pd.DataFrame({"text": pdf["text"], "score": [b[0] for b in best], "canonical": [b[2] for b in best]})

    best = queries.mapInPandas(run, "text string, score double, canonical string")
    joined = texts.join(best, "text", "left")
    return joined.select(key, "text", F.when(F.col("score") >= threshold, F.col("canonical")).alias("match"), F.coalesce("score", F.lit(0.0)).alias("score"))


def strata(rows: DataFrame, item: str, train_items: DataFrame) -> DataFrame:
    """The rows marked repeated when their item, case and outer blanks aside, occurs in training, else novel."""
    known = train_items.select(F.lower(trimmed(F.col("item"))).alias("__i")).where("__i is not null").distinct().withColumn("__k", F.lit(True))
    return rows.withColumn("__i", F.lower(trimmed(F.col(item)))).join(known, "__i", "left").withColumn("stratum", F.when(F.col("__k"), "repeated").otherwise("novel")).drop("__i", "__k")


def index_map(rows: DataFrame, row: str, mapping: dict) -> DataFrame:
    """(row, value): values by row number; a key may be the number or its plain text, the number wins."""
    exact = {k: v for k, v in mapping.items() if isinstance(k, int)}
    plain = {int(k): v for k, v in mapping.items() if isinstance(k, str) and k.isdecimal() and str(int(k)) == k}
    table = rows.sparkSession.createDataFrame(sorted((plain | exact).items()), f"`{row}` bigint, value string")
    return rows.select(row).join(table, row, "left")
