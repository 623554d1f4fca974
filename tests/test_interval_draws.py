"""Intervals of groups of different sizes share the hashed numbers and equal those of each group alone."""

import numpy as np
import pytest

from tidewright.operators import resample as S


def test_groups_share_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(m, c, f"p{i:03d}", float(rng.normal()), 1) for m in "xy" for c, size in (("a", 40), ("b", 33), ("aggregate", 40)) for i in range(size)]
    made = lambda some: {(r.model, r.category): (r.point, r.low, r.high) for r in S.bootstrap_means(spark.createDataFrame(some, "model string, category string, cluster string, s double, n bigint"), ["model", "category"], 30, 42).collect()}
    whole = made(rows)
    assert len(whole) == 6
    assert whole["x", "b"] == pytest.approx(made([r for r in rows if r[:2] == ("x", "b")])["x", "b"])
    assert {c for s in ([33, 40],) for c in S._drawn(42, 0, s)} == {33, 40} and S._drawn(42, 0, [33, 40])[33].sum() == 33
