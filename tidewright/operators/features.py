"""Vectors, fusion features and models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def l2_normalised(vector: str, floor: float = 1e-9) -> Column:
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(size, F.lit(floor)))


def fused(item: str, context: str, mode: str = "3d") -> Column:
    """[e, c]; with 3d also e * c; with 4_vector also |e - c|."""
    parts = [F.col(item), F.col(context)]
    if mode in ("3d", "4_vector"):
        parts.append(F.zip_with(item, context, lambda a, b: a * b))
    if mode == "4_vector":
        parts.append(F.zip_with(item, context, lambda a, b: F.abs(a - b)))
    if mode not in ("2d", "lowrank", "3d", "4_vector"):
        raise ValueError(f"unknown fusion {mode}")
    return F.concat(*parts)


def context_vectors(rows: DataFrame, vectors: DataFrame, key: str, size: int) -> DataFrame:
    """The rows with the vector of their key as ``context``, zeros where there is none."""
    return rows.join(vectors.select(key, F.col("vector").alias("context")), key, "left").withColumn("context", F.coalesce("context", F.array_repeat(F.lit(0.0), size)))


def ablated_contexts(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each record once per field, with that field empty."""
    empty = lambda c, f: F.when(F.col("field") == f, F.lit(None)).otherwise(F.col(c)).alias(c)
    return records.withColumn("field", F.explode(F.array(*map(F.lit, fields)))).select(key, "field", *(empty(f, f) for f in fields))


def pooled(tokens: DataFrame, key: str, position: str, vector: str, mode: str = "mean", weight: str | None = None) -> DataFrame:
    """(key, vector): mean, max, first (CLS), last or weighted pooling of token vectors."""
    long = tokens.select(key, position, F.posexplode(vector).alias("d", "x"), *([F.col(weight).alias("__w")] if weight else []))
    value = {
        "mean": F.avg("x"), "max": F.max("x"), "cls": F.min_by("x", position), "last": F.max_by("x", position),
        "attention": F.sum(F.col("x") * F.col("__w")) / F.sum("__w") if weight else F.avg("x"),
    }[mode]
    per = long.groupBy(key, "d").agg(value.alias("x"))
    return per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("s")).select(key, F.col("s.x").alias("vector"))


def encoded(texts: DataFrame, text: str, encoder, dims: int, batch: int = 256) -> DataFrame:
    """(text, vector): distinct texts through a pluggable encoder of lists of texts, L2-normalised."""
    schema = f"`{text}` string, vector array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                made = np.asarray(encoder(list(part[text])), float)
                if made.shape[1] != dims:
                    raise ValueError("the encoder gives vectors of another length")
                yield pd.DataFrame({text: part[text].to_numpy(), "vector": list(made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9))})

    return texts.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, schema)


def hashed_encoder(dims: int = 64):
    """An encoder without a model: counts of hashed words."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % dims] += 1
        return out

    return encode


def whitened(rows: DataFrame, vector: str, k: int) -> tuple[DataFrame, dict]:
    """The rows with ``k`` whitened principal components of the standardised vector, and the fitted parameters.

    Population moments. The moment sums are added up in Spark; only a matrix of
    the vector's size reaches the driver.
    """
    size = rows.select(F.size(vector)).where(F.size(vector) > 0).first()
    if size is None:
        return rows.withColumn("components", F.array().cast("array<double>")), {}
    d = size[0]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy()).astype(float)
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    parts = rows.select(vector).where(F.col(vector).isNotNull()).mapInPandas(moments, "n bigint, s array<double>, q array<double>")
    sums = lambda c: [r[0] for r in parts.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").select("x").collect()]
    n = parts.agg(F.sum("n")).first()[0]
    mean, second = np.array(sums("s")) / n, np.array(sums("q")).reshape(d, d) / n
    cov = second - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, vectors = np.linalg.eigh(cov / np.outer(std, std))
    top = np.argsort(values)[::-1][:k]
    basis = vectors[:, top] * np.where(vectors[:, top][np.abs(vectors[:, top]).argmax(0), range(len(top))] < 0, -1, 1)
    scale = np.sqrt(np.maximum(values[top], 1e-12))
    held = {"mean": mean, "std": std, "basis": basis, "scale": scale}

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf[vector].to_numpy()).astype(float) if len(pdf) else np.zeros((0, d))
            yield pdf.assign(components=list((x - mean) / std @ basis / scale))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", components array<double>"
    return rows.where(F.col(vector).isNotNull()).mapInPandas(project, schema), held


def class_weight(positives: Column, rows: Column, mode: str = "effective", beta: float = 0.999, cap: float = 50.0) -> Column:
    """Weight of the positive side, from 1 to the cap: (1 - beta) / (1 - beta^m) of the effective number, or ("balanced") rows by twice the positives."""
    m = F.greatest(positives, F.lit(1))
    raw = (1 - beta) / (1 - F.pow(F.lit(beta), m)) if mode == "effective" else rows / (2 * m)
    return F.least(F.greatest(raw, F.lit(1.0)), F.lit(cap))


def soft_logistic(rows: DataFrame, vector: str, label: str, weight: str | None = None, l2: float = 0.01, iterations: int = 50):
    """Logistic regression on soft labels: each row counts as a positive of weight y and a negative of weight 1 - y."""
    w = F.col(weight) if weight else F.lit(1.0)
    sides = F.array(F.struct(F.lit(1.0).alias("target"), (F.col(label) * w).alias("w")), F.struct(F.lit(0.0).alias("target"), (1 - F.col(label)).alias("w")))
    data = rows.where(F.col(label).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.inline(sides)).where("w > 0")
    return LogisticRegression(labelCol="target", weightCol="w", regParam=l2, maxIter=iterations).fit(data)


def predicted(rows: DataFrame, model, vector: str) -> DataFrame:
    """The rows with the model's probability as column p."""
    scored = model.transform(rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fusion_or_passthrough(rows: DataFrame, fused_p: str, plain_p: str, label: str) -> Column:
    """The fused prediction when its mean Brier score is smaller than the plain one's, else the plain one."""
    gap = lambda c: F.avg((F.col(c) - F.col(label)) * (F.col(c) - F.col(label)))
    a, b = rows.agg(gap(fused_p), gap(plain_p)).first()
    return F.col(fused_p if a is not None and b is not None and a < b else plain_p)


def ensemble_mean(preds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p): the mean of the folds' predictions, clipped to 0 to 1."""
    return preds.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("p"))).alias("p"))


def one_hot(entity: str, entities: list[str]) -> Column:
    """The entity's indicator vector over a given list; zeros for another entity."""
    return F.transform(F.array(*map(F.lit, entities)), lambda e: F.when(e == F.col(entity), 1.0).otherwise(0.0))


def usable_token(text: Column, category: Column) -> Column:
    """Whether a field holds a value: neither blank nor the mere name of its category."""
    return text.isNotNull() & (F.trim(text) != "") & (F.lower(F.trim(text)) != F.lower(category))
