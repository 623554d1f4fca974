"""The hash draws of bootstrap_means: the definition, the pieces in which they are made, and that no draw is a row."""

import hashlib

import numpy as np
import pytest

from tidewright.operators import resample as S


def hashed(seed, r, j):
    return int(hashlib.md5(f"{seed}:{r}:{j}".encode()).hexdigest()[:8], 16)


def by_definition(table, resamples, seed):
    s, n = (np.array([x[i] for x in sorted(table)]) for i in (1, 2))
    means = []
    for r in range(resamples):
        k = [hashed(seed, r, j) % len(s) for j in range(len(s))]
        means.append(s[k].sum() / n[k].sum())
    return [s.sum() / n.sum(), *np.percentile(means, [2.5, 97.5])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, cluster string, s double, n bigint")


@pytest.mark.parametrize(("seed", "r", "first", "last"), [(42, 0, 0, 12_000), (42, 999, 98_700, 101_300), (-7, 10, 5, 6), (10**52, 1, 99_000, 101_100)])
def test_numbers_are_md5(seed, r, first, last):
    assert S.draw_numbers(seed, r, first, last).tolist() == [hashed(seed, r, j) for j in range(first, last)]


@pytest.mark.parametrize(("block", "held"), [(1 << 16, 1 << 21), (5, 12)])
def test_pieces_change_no_draw(spark, monkeypatch, block, held):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "HELD", held)
    rng = np.random.default_rng(3)
    tables = {g: [(f"c{i:03d}", float(rng.normal()), int(rng.integers(1, 9))) for i in range(size)] for g, size in {"a": 23, "b": 23, "c": 2, "d": 61, "one": 1}.items()}
    got = {r.g: r for r in S.bootstrap_means(frame(spark, [(g, *x) for g, t in tables.items() for x in t]), ["g"], 40, 42).collect()}
    for g in "abcd":
        assert [got[g].point, got[g].low, got[g].high] == pytest.approx(by_definition(tables[g], 40, 42))
    assert got["one"].point == tables["one"][0][1] / tables["one"][0][2] and got["one"].low is None


def test_a_sum_that_is_no_number_counts_where_it_is_drawn(spark):
    table = [("a", 1.0, 1), ("b", float("inf"), 1), ("c", 3.0, 1)]
    undrawn = [r for r in range(30) if 1 not in [hashed(42, r, j) % 3 for j in range(3)]]
    got = S.bootstrap_means(frame(spark, [("g", *x) for x in table]), ["g"], 30, 42).first()
    assert undrawn and got.low < 3.1 and got.high == float("inf")


def test_no_draw_is_a_row(spark):
    """Rows between the steps of a group of 3,000 clusters: its blocks and a sum per resample, not 3,000 x 100 draws."""
    df = S.bootstrap_means(frame(spark, [("g", f"c{i:05d}", float(i), 1) for i in range(3000)]), ["g"], 100, 42)
    assert "md5" not in df._jdf.queryExecution().toString()
    row = df.first()
    assert row.low < row.point == 1499.5 < row.high


def test_empty(spark):
    assert S.bootstrap_means(frame(spark, []), ["g"], 10, 42).collect() == []
