"""Mixing sources to target weights: soft membership and projected-gradient rates.

Sizes are tokens of a public tokenizer. A document of a known source (trimmed,
lower case) belongs to it wholly. A document without source belongs to the
target sources by the posteriors of a naive Bayes classifier that is fitted on
labelled documents, at most SAMPLE of them in expectation. A document of a
source without target belongs to none.

Each document gets a nonnegative rate (expected number of copies), at most the
repeats of its source, so that the expected tokens of each source match its
target share of the total: nonnegative least squares by projected gradient,
scaled by document length so that the documents of a source get one rate. The
rate after some steps follows from the residuals of the steps, a few numbers
each, so a step is one aggregation over cells: documents whose memberships agree
in steps of 1/GRAIN are added up beforehand, with the mean of their memberships
by tokens. Ids, names and numbers alone are written down, never texts.

The total is the largest at which no source with documents needs more repeats
than it may have, so the shares are met as nearly as the repeats allow; a
source without documents is left out and the others share its part. A larger
``total`` can be asked for; sources that can't keep up then fall short. With
``count_soft`` the expected tokens of documents without source count in the
total, and their rates move at the pace of all others; without it they only
fill what known sources can't give.

Rates become whole copies: of each known source the documents of smallest hash
get the copy more that the rate asks for, as many as come nearest in tokens.

Null and empty texts have no tokens and are left out; an empty table gives an
empty mixture. A repeated row takes part once per row.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import cut, spread

SAMPLE = 50_000
FEATURES = 1 << 14
STEPS = 60
#: Pace at which the rates of documents without source grow unless they count: those of known source are used first.
SOFT_PACE = 0.0001
#: Residual at which the fit ends, and gain below which a step is none, as shares of all tokens: rates become whole copies by
#: hash in BINS parts of a source, so a finer fit would change nothing.
TOLERANCE, GAIN = 1e-4, 1e-5
BINS = 4096
MAX_SOURCES = 1000
#: Steps of a membership within which documents count as one cell of the fit.
GRAIN = 32


def token_counts(texts: Column, vocabulary: str, pattern: str) -> Column:
    """The number of tokens of each text under a byte-level vocabulary file of ranks."""
    made: list = []

    @F.pandas_udf(T.LongType())
    def count(batch: pd.Series) -> pd.Series:
        import tiktoken

        if not made:
            with open(vocabulary, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            made.append(tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return batch.map(lambda t: len(made[0].encode_ordinary(t)) if t else 0)

    return count(texts)


def source_name(column: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(column, r"[\s\p{Z}]+", " "))), F.lit(""))


def _features(docs: DataFrame) -> DataFrame:
    words = F.concat(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0)), F.array(F.concat(F.lit("kind="), F.coalesce("kind", F.lit("")))))
    return HashingTF(numFeatures=FEATURES, inputCol="words", outputCol="features").transform(docs.withColumn("words", words))


def posteriors(docs: DataFrame, sources: list[str], sample: int = SAMPLE) -> DataFrame:
    """The documents without source and their membership, in the order of sources."""
    known = docs.where(F.col("name").isin(sources))
    share = min(1.0, sample / max(known.count(), 1))
    labelled = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    number = F.array_position(F.array(*map(F.lit, sources)), F.col("name")) - 1
    fitted = cut(_features(labelled).select("features", number.cast("double").alias("label")))  # of the sample
    unknown = docs.where("name is null")
    present = {int(r[0]) for r in fitted.select("label").distinct().collect()}  # at most as many as target sources
    if len(present) < 2:
        one = [1.0 if i in present else 0.0 for i in range(len(sources))]
        return unknown.withColumn("membership", F.array(*map(F.lit, one)))
    model = NaiveBayes(smoothing=0.1, modelType="multinomial").fit(fitted)
    scored = model.transform(_features(unknown))
    p = vector_to_array("probability")
    # classes that the sample lacks have no posterior
    shares = [F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) * (1.0 if i in present else 0.0) for i in range(len(sources))]
    return scored.withColumn("__m", F.array(*shares)).withColumn("membership", F.expr("transform(__m, x -> x / greatest(aggregate(__m, 0D, (a, b) -> a + b), 1e-12))")).select(*unknown.columns, "membership")


def cells_of(parts: DataFrame, n: int) -> DataFrame:
    """(membership, cap, pace, tokens): documents of like membership added up, with their means by tokens."""
    weight = F.col("n_tokens").cast("double")
    mean = lambda c: F.sum(c * weight) / F.sum(weight)
    grain = F.transform("membership", lambda m: F.round(m * GRAIN).cast("int"))
    kept = parts.where("n_tokens > 0").groupBy(grain.alias("grain"), F.round(F.col("cap") * GRAIN).alias("cap_grain"), "pace")
    return kept.agg(F.array(*(mean(F.col("membership")[i]) for i in range(n))).alias("membership"), mean(F.col("cap")).alias("cap"), F.sum(weight).alias("tokens")).drop("grain", "cap_grain")


def _rate(history: list[list[float]]) -> Column:
    """The rate of a document after the steps: r <- clip(r - membership . step, 0, cap)."""
    if not history:
        return F.lit(0.0)
    steps = F.array(*(F.array(*map(F.lit, e)) for e in history))
    dot = lambda e: F.aggregate(F.zip_with("membership", e, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(steps, F.lit(0.0), lambda r, e: F.greatest(F.lit(0.0), F.least(F.col("cap"), r - F.col("pace") * dot(e))))


def _totals(cells: DataFrame, amount: Column, n: int) -> list[float]:
    row = cells.select((amount * F.col("tokens")).alias("w"), "membership").agg(*(F.sum(F.col("w") * F.col("membership")[i]) for i in range(n))).first()
    return [float(x or 0.0) for x in row]


def fit_rates(cells: DataFrame, goals: list[float]) -> list[list[float]]:
    """The steps of projected gradient that bring the expected tokens of each source as near to its goal as they come.

    A step is scaled by the tokens that can still move in its direction, so
    sources whose documents are at their bounds go on with those that aren't.
    """
    n = len(goals)
    history: list[list[float]] = []
    best, kept = None, 0
    for _ in range(STEPS):
        rated = cells.withColumn("r", _rate(history)).withColumn("w", F.col("r") * F.col("tokens"))
        moving = lambda free: F.when(free, F.col("pace") * F.col("tokens")).otherwise(0.0)
        rated = rated.withColumn("up", moving(F.col("r") < F.col("cap") - 1e-12)).withColumn("down", moving(F.col("r") > 1e-12))
        sums = rated.agg(*(F.sum(F.col(c) * F.col("membership")[i]) for c in ("w", "up", "down") for i in range(n))).first()
        have, up, down = (([float(x or 0.0) for x in sums[k * n : (k + 1) * n]]) for k in range(3))
        off = [h - g for h, g in zip(have, goals, strict=True)]
        size = sum(o * o for o in off) ** 0.5
        if best is None or size < best - GAIN * max(sum(goals), 1.0):
            best, kept = size, len(history)
        elif len(history) > kept + 5:
            break
        if size <= TOLERANCE * max(sum(goals), 1.0):
            break
        free = [u if o < 0 else d for o, u, d in zip(off, up, down, strict=True)]
        history.append([o / f if f > 0 else 0.0 for o, f in zip(off, free, strict=True)])
    return history[:kept]


def mixture(docs: DataFrame, targets: DataFrame, vocabulary: str, pattern: str, total: float | None = None, sample: int = SAMPLE, count_soft: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", kind_col: str = "doc_kind") -> DataFrame:
    """(doc_id, source, n_tokens, rate, n_copies, membership): the documents of the mixture, with at least one copy each.

    source is null for a document without source; membership is in the order of
    the sorted target sources.
    """
    listed = targets.select(source_name(F.col("source")).alias("s"), F.col("target_share").cast("double"), F.col("max_repeats").cast("double")).where("s is not null").orderBy("s").limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    sources, shares, repeats = [r[0] for r in listed], [r[1] or 0.0 for r in listed], [r[2] if r[2] is not None else 1.0 for r in listed]
    if not listed:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, rate double, n_copies bigint, membership array<double>")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(kind_col).cast("string").alias("kind"), source_name(F.col(source_col)).alias("name")).where("text is not null and text <> ''")
    texts = spread(texts)
    index = F.array_position(F.array(*map(F.lit, sources)), F.col("name"))
    one_hot = F.transform(F.sequence(F.lit(1), F.lit(len(sources))), lambda i: F.when(i == index, 1.0).otherwise(0.0))
    cap = F.aggregate(F.zip_with("membership", F.array(*map(F.lit, repeats)), lambda m, r: m * r), F.lit(0.0), lambda a, b: a + b)
    counted = lambda df: df.select("doc_id", "name", token_counts(F.col("text"), vocabulary, pattern).alias("n_tokens"), "membership")
    known = counted(texts.where(F.col("name").isin(sources)).withColumn("membership", one_hot))
    soft = F.col("name").isNull()
    parts = known.unionByName(counted(posteriors(texts, sources, sample))).withColumn("cap", F.when(soft, F.least(F.lit(1.0), cap)).otherwise(cap))
    parts = cut(parts.withColumn("pace", F.when(soft, F.lit(1.0 if count_soft else SOFT_PACE)).otherwise(F.lit(1.0))))
    cells = cut(cells_of(parts, len(sources)))

    able = _totals(cells if count_soft else cells.where("pace = 1"), F.col("cap"), len(sources))
    here = [s if a > 0 else 0.0 for s, a in zip(shares, able, strict=True)]
    whole = sum(here) or 1.0
    largest = min((a / (s / whole) for s, a in zip(here, able, strict=True) if s > 0), default=0.0)
    goals = [s / whole * (total if total is not None else largest) for s in here]
    history = fit_rates(cells, goals)
    rated = parts.withColumn("rate", _rate(history)).withColumn("u", F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40)))

    # of a known source: whole copies, and one more below a hash threshold that comes nearest in tokens
    bins = rated.where("name is not null").groupBy("name", F.floor(F.col("u") * BINS).alias("bin")).agg(F.sum("n_tokens").alias("t"), F.max("rate").alias("rate"))
    near = bins.selectExpr("name", "bin", "t", "rate - floor(rate + 1e-9) as part")
    run = F.sum("t").over(W.partitionBy("name").orderBy("bin"))  # at most BINS rows a source
    want = F.col("part") * F.sum("t").over(W.partitionBy("name"))
    edges = near.select("name", "bin", (run - want).alias("over"), (want - (run - F.col("t"))).alias("under"), "part")
    chosen = edges.where("part > 1e-9 and under >= over").groupBy("name").agg(F.coalesce(F.max(F.when(F.col("under") > 0, F.col("bin"))), F.lit(-1)).alias("bin"))
    more = rated.join(F.broadcast(chosen.withColumnRenamed("bin", "last")), "name", "left")
    extra = F.when(F.col("name").isNull(), F.col("u") < F.col("rate") - F.floor(F.col("rate") + 1e-9)).otherwise(F.floor(F.col("u") * BINS) <= F.coalesce("last", F.lit(-1)))
    copies = (F.floor(F.col("rate") + 1e-9) + extra.cast("int")).cast("bigint")
    return more.withColumn("n_copies", copies).where("n_copies > 0").select("doc_id", F.col("name").alias("source"), "n_tokens", "rate", "n_copies", "membership")


def mixture_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its target and actual share of all tokens of the mixture, by documents of that source and with the
    expected part of documents without source; documents, tokens and the most copies of one document."""
    names = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    order = [r[0] for r in names.select("source").orderBy("source").collect()]  # at most MAX_SOURCES
    mixed = cut(mixed)
    amount = (F.col("n_tokens") * F.col("n_copies")).alias("w")
    expected = mixed.select(F.posexplode("membership").alias("i", "m"), amount).groupBy("i").agg(F.sum(F.col("m") * F.col("w")).alias("expected"))
    expected = expected.withColumn("source", F.array(*map(F.lit, order))[F.col("i")]).drop("i")
    own = mixed.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens"), F.max("n_copies").alias("most_copies"))
    whole = mixed.agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = names.join(own, "source", "left").join(expected, "source", "left").withColumn("all", whole.scalar())
    return joined.select(
        "source", "target_share", "max_repeats", zero("n_docs"), zero("tokens"), zero("most_copies"),
        F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("own_share"), F.coalesce(F.col("expected") / F.col("all"), F.lit(0.0)).alias("actual_share"),
    )
