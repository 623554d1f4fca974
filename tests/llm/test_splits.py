import random

import pytest
from pyspark.sql import functions as F

from tidewright.llm import splits

IDS = ["patient_id", "author_id", "source_id"]
SCHEMA = "row_id bigint, patient_id string, author_id string, source_id string, root string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    """Row to group number by union-find on usable ids."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def number(s):
        digits = "".join(c for c in (s or "").split(".")[0] if c.isdigit())
        return int(digits) if digits else None

    nodes = {}
    for row, *ids in rows:
        own = [(i, number(v)) for i, v in enumerate(ids) if number(v) is not None]
        nodes[row] = own
        for a, b in zip(own, own[1:]):
            parent[find(a)] = find(b)
    groups = {}
    for row, own in nodes.items():
        if own:
            groups.setdefault(find(own[0]), []).append(row)
    least = {}
    for row, own in nodes.items():
        for kind, n in own:
            if kind == 0:
                g = find(own[0])
                least[g] = min(least.get(g, n), n)
    return {row: (g, least.get(g)) for g, rows_ in groups.items() for row in rows_}


@pytest.mark.parametrize("small", [0, 50, splits.SMALL_GRAPH])
def test_groups_against_union_find(spark, monkeypatch, small):
    monkeypatch.setattr(splits, "SMALL_GRAPH", small)
    rng = random.Random(3)
    rows = []
    for i in range(400):
        p = rng.choice([None, "unknown", f"{rng.randrange(120):05d}", f" {rng.randrange(120)}", f"{rng.randrange(120)}.0"])
        a = rng.choice([None, "n/a", "?", f"AU-{rng.randrange(150):07d}", f"au-{rng.randrange(150)} "])
        s = rng.choice([None, "-", "", f"SF-{rng.randrange(150):07d}", f"SF{rng.randrange(150)}"])
        rows.append((i, p, a, s))
    want = brute(rows)
    got = {r.row_id: (r.root, r.group_no) for r in splits.grouped(frame(spark, rows), "row_id", IDS).collect()}
    assert len(got) == len(rows)
    assert {r for r, (root, _) in got.items() if root is not None} == set(want)
    assert {r: n for r, (root, n) in got.items() if root is not None} == {r: n for r, (_, n) in want.items()}
    pairs = {(got[r][0], want[r][0]) for r in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize("small", [0, splits.SMALL_GRAPH])
def test_long_chain_is_one_group(spark, monkeypatch, small):
    monkeypatch.setattr(splits, "SMALL_GRAPH", small)
    rows = [(i, f"{i // 2}", f"A{(i + 1) // 2}", None) for i in range(400)]
    got = splits.grouped(frame(spark, rows), "row_id", IDS).select("root", "group_no").distinct().collect()
    assert [r.group_no for r in got] == [0] * len(got)
    assert len(got) == 1


def test_splits_are_near_their_shares_and_keep_groups(spark):
    rows = [(i, str(i % 97) if i % 3 else "101", f"A{i % 89}" if i % 7 == 0 else None, None) for i in range(300)] + [(1000 + i, str(5000 + i), None, None) for i in range(600)] + [(5000 + i, None, "none", None) for i in range(100)]
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    assigned = splits.assign_splits(splits.grouped(frame(spark, rows), "row_id", IDS), shares)
    assert assigned.count() == len(rows)
    assert assigned.where("root is not null").groupBy("root").agg({"split": "max"}).count() == assigned.where("root is not null").select("root", "split").distinct().count()
    report = {r.split: r.share for r in splits.split_report(assigned).collect()}
    assert all(abs(report[s] - want) < 0.05 for s, want in shares.items())


def test_empty_and_unusable(spark):
    assert splits.grouped(frame(spark, []), "row_id", IDS).count() == 0
    assert splits.assign_splits(splits.grouped(frame(spark, []), "row_id", IDS), {"train": 1.0}).count() == 0
    got = splits.grouped(frame(spark, [(1, None, "unknown", ""), (2, "7", None, None), (2, "007", None, None)]), "row_id", IDS).collect()
    assert sorted((r.row_id, r.group_no) for r in got if r.root) == [(2, 7), (2, 7)]
    assert [r.group_no for r in got if r.row_id == 1] == [None]


def test_long_ids(spark):
    big = "9" * 30
    got = splits.grouped(frame(spark, [(1, big, None, None), (2, "00" + big, None, None), (3, "x" * 100_000, None, None)]), "row_id", IDS).collect()
    assert len({r.root for r in got if r.row_id < 3}) == 1
    assert all(r.group_no is None for r in got)


def test_root_and_split_follow_from_the_rows_alone(spark, monkeypatch):
    """The size at which a graph is merged in one task changes neither the root nor the split of any row."""
    rng = random.Random(6)
    rows = [(i, str(rng.randrange(300)), f"A{rng.randrange(400)}" if i % 2 else None, f"S{rng.randrange(500)}" if i % 5 == 0 else None) for i in range(500)]
    rows += [(1000 + i, str(900 + i), "A9999", None) for i in range(1500)]  # a hub
    seen = []
    for small in (0, 200, splits.SMALL_GRAPH):
        monkeypatch.setattr(splits, "SMALL_GRAPH", small)
        groups = splits.grouped(frame(spark, rows), "row_id", IDS)
        seen.append(sorted((r.row_id, r.root, r.split) for r in splits.assign_splits(groups, {"train": 0.7, "val": 0.15, "test": 0.15}).collect()))
    assert seen[0] == seen[1] == seen[2] and len({root for i, root, _ in seen[0] if i >= 1000}) == 1


def test_ids_of_several_numbers_and_other_rules(spark):
    rows = [(1, "A12-B3", None, None), (2, "a012/b03", None, None), (3, "A12-B4", None, None), (4, "Zoe", None, None), (5, " zoe", None, None)]
    roots = {r.row_id: r.root for r in splits.grouped(frame(spark, rows), "row_id", IDS).collect()}
    assert roots[1] == roots[2] != roots[3] and roots[4] is None
    named = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    roots = {r.row_id: r.root for r in splits.grouped(frame(spark, rows), "row_id", IDS, named).collect()}
    assert roots[4] == roots[5] is not None and len(set(roots.values())) == 4
