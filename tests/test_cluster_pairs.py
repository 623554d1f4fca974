"""Pairs of a shared block that can't be similar are dropped before they are shuffled or compared; the edges stay those of comparing all."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tidewright.operators import fuzzy as Z


def test_bound_keeps_every_edge(spark, monkeypatch):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefghij ", k=rng.randrange(4, 16))) + f" {tail}" for tail in ("tablet", "capsule") for _ in range(90)]
    names += [n[:3] + n[4:] for n in names[::9]] + [f"old {n}" for n in names[::11]] + ["aaaaaaaa tablet", "aaaaaaa tablet"]
    items = Z.distinct_items(spark.createDataFrame([(n,) for n in names], "item string"), "item").localCheckpoint()
    norm = {r.id: r.norm for r in items.collect()}
    pairs = Z.candidate_pairs(items).collect()
    want = {}
    for a, b in pairs:
        inside = norm[a] in norm[b] or norm[b] in norm[a]
        if (sim := Z.similarity(norm[a], norm[b])) >= (0.75 * 0.85 if inside else 0.85):
            want[a, b] = sim
    compared = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([Z.similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    monkeypatch.setattr(Z, "similarity_udf", counted)
    assert {(r.a, r.b): r.sim for r in Z.similar_edges(items, 85).collect()} == want and len(want) > 20
    assert len(want) <= compared.value < len(pairs) / 10


def test_estimated_size_stays_small(spark):
    path = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)]
    found = Z.connected_components(spark.createDataFrame(path, "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(101)}
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 60
