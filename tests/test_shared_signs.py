"""The signs of a cluster are made once for all of its groups and change no result."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.operators import resample as S


def by_row(rows, permutations, seed, spark):
    """The sampled sign flip with the signs of each row of its own."""
    df = spark.createDataFrame(rows, "g string, k int, cluster string, s double").withColumn("h", F.xxhash64(F.lit(seed), "cluster"))
    held = {}
    for g, k, _, s, h in df.collect():
        signs = np.random.default_rng(h & 0xFFFFFFFFFFFFFFFF).integers(0, 2, permutations, dtype=np.int8) * 2 - 1
        acc = held.setdefault((g, k), [np.zeros(permutations), 0.0, 0.0, 0])
        acc[0] += signs * s
        acc[1], acc[2], acc[3] = acc[1] + s, acc[2] + abs(s), acc[3] + 1
    return {key: (n, pytest.approx(observed, nan_ok=True), (1 + sum(np.isnan(null) | (null >= observed - 1e-12 * max(1.0, size)))) / (permutations + 1)) for key, (null, observed, size, n) in held.items()}


def test_signs_of_a_cluster_are_shared_by_its_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "SIGNED", 7)
    monkeypatch.setattr(S, "SUMMED", 2)
    rng = np.random.default_rng(4)
    rows = [(g, k, f"c{i}", float(rng.normal(0.2))) for g in "ab" for k in (1, 2, None) for i in range(20 + 9 * (g == "a")) if rng.random() < 0.9]
    rows += [("nan", 1, f"c{i}", float("nan") if i == 2 else 1.0) for i in range(6)]
    sums = spark.createDataFrame([(*r, 1) for r in rows], "g string, k int, cluster string, s double, n bigint")
    got = {(r.g, r.k): (r.n_clusters, r.observed, r.p) for r in S.sign_flip_sampled(sums, ["g", "k"], 300, 42).collect()}
    assert got == by_row(rows, 300, 42, spark)


def test_a_cluster_makes_its_signs_once():
    made, plain = [], np.random.default_rng
    try:
        np.random.default_rng = lambda h: made.append(h) or plain(h)
        n = 40
        batch = pa.RecordBatch.from_pydict({"g": [f"g{i % 8}" for i in range(n)], "s": [1.0] * n, "__h": pa.array([i // 8 for i in range(n)], pa.int64())})
        out = list(S._flipped(iter([batch]), ["g"], 11))
    finally:
        np.random.default_rng = plain
    assert len(made) == n // 8 and out[0].num_rows == 8
