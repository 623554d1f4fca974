import datetime
import random

import numpy as np
import pytest

from tidewright.llm import consensus as C

SCHEMA = "label_id bigint, pair_id bigint, physician string, category string, vote int, voted_at timestamp, loaded_at timestamp, observer string, p double"
ITEM = ["pair_id", "category"]
T0 = datetime.datetime(2024, 1, 1)


def frame(spark, rows):
    """rows: (pair, physician, category, vote, hours)."""
    return spark.createDataFrame([(i, p, o, c, v, T0 + datetime.timedelta(hours=h), T0, "x", 0.5) for i, (p, o, c, v, h) in enumerate(rows)], SCHEMA)


def simulated(seed=1, items=300):
    rng = random.Random(seed)
    skill = {f"O{i}": (rng.uniform(0.85, 0.97), rng.uniform(0.85, 0.97)) for i in range(6)} | {f"B{i}": (0.55, 0.5) for i in range(4)} | {"R": (0.1, 0.1)}
    truth, rows = {}, []
    for i in range(items):
        truth[i] = int(rng.random() < 0.35)
        for o in rng.sample(sorted(skill), 7):
            good = rng.random() < skill[o][0 if truth[i] else 1]
            rows.append((i, o, "c", truth[i] if good else 1 - truth[i], 0))
    return truth, rows, skill


def brute_em(rows, rounds=C.ROUNDS):
    items = sorted({r[0] for r in rows})
    observers = sorted({r[1] for r in rows})
    votes = {(r[0], r[1]): r[3] for r in rows}
    p = {i: (sum(v for (a, _), v in votes.items() if a == i) + 0.5) / (sum(a == i for a, _ in votes) + 1.0) for i in items}
    old = None
    for _ in range(rounds + 1):
        sens, spec = {}, {}
        for o in observers:
            own = [(p[i], v) for (i, b), v in votes.items() if b == o]
            sens[o] = (sum(x * v for x, v in own) + 2) / (sum(x for x, _ in own) + 3)
            spec[o] = (sum((1 - x) * (1 - v) for x, v in own) + 2) / (sum(1 - x for x, _ in own) + 3)
        prior = (sum(p.values()) + 1) / (len(p) + 2)
        now = np.array([*sens.values(), *spec.values(), prior])
        if old is not None and np.abs(now - old).max() < C.TOLERANCE:
            break
        old = now
        for i in items:
            z = np.log(prior / (1 - prior))
            for o in observers:
                if (i, o) in votes:
                    z += np.log(sens[o] / (1 - spec[o])) if votes[i, o] else np.log((1 - sens[o]) / spec[o])
            p[i] = 1 / (1 + np.exp(-z))
    z = {}
    for i in items:
        s = np.log(prior / (1 - prior))
        for o in observers:
            if (i, o) in votes:
                s += np.log(sens[o] / (1 - spec[o])) if votes[i, o] else np.log((1 - sens[o]) / spec[o])
        z[i] = 1 / (1 + np.exp(-s))
    return z, sens, spec


def test_against_brute_force(spark):
    truth, rows, skill = simulated()
    want, sens, spec = brute_em(rows)
    got = {r.pair_id: r for r in C.consensus(frame(spark, rows), ITEM, "category").collect()}
    assert set(got) == set(want)
    assert max(abs(got[i].posterior - want[i]) for i in want) < 1e-6
    rel = {r.observer: r for r in C.reliability(frame(spark, rows), ITEM, "category").collect()}
    assert max(abs(rel[o].sensitivity - sens[o]) for o in sens) < 1e-6 and max(abs(rel[o].specificity - spec[o]) for o in spec) < 1e-6
    right = np.mean([got[i].label == truth[i] for i in truth])
    majority = np.mean([(got[i].n_ones * 2 > got[i].n_votes) == truth[i] for i in truth])
    assert right >= majority and right > 0.95
    assert rel["R"].balanced < 0.4 < 0.8 < rel["O0"].balanced


def test_latest_vote_holds(spark):
    rows = [(1, "a", "c", 0, 5), (1, "a", "c", 1, 9), (1, "a", "c", 0, 7), (1, "b", "c", 1, 1), (1, "b", "c", 1, 1), (1, "n", "c", None, 3), (2, "a", "c", None, 1), (1, None, "c", 0, 1), (1, "r", "c", 1, 1), (1, "r", "c", None, 2)]
    held = {(r.pair_id, r.observer): r.vote for r in C.valid_votes(frame(spark, rows), ITEM).collect()}
    assert held == {(1, "a"): 1, (1, "b"): 1}


def test_agreement_against_brute_force(spark):
    _, rows, _ = simulated(4, 40)
    got = C.agreement(frame(spark, rows), ITEM, "category").first()
    items = {}
    for i, _, _, v, _ in rows:
        items.setdefault(i, []).append(v)
    n = sum(map(len, items.values()))
    unlike = sum(sum(a != b for x, a in enumerate(v) for y, b in enumerate(v) if x != y) / (len(v) - 1) for v in items.values()) / n
    flat = [v for own in items.values() for v in own]
    chance = sum(a != b for x, a in enumerate(flat) for y, b in enumerate(flat) if x != y) / (n * (n - 1))
    assert got.observed == pytest.approx(unlike) and got.expected == pytest.approx(chance) and got.alpha == pytest.approx(1 - unlike / chance)


def test_empty_and_one_sided(spark):
    assert C.consensus(frame(spark, []), ITEM, "category").count() == 0 and C.agreement(frame(spark, []), ITEM, "category").count() == 0
    same = [(i, f"o{j}", "c", 1, 0) for i in range(5) for j in range(3)] + [(9, "o1", None, 1, 0)]
    assert C.agreement(frame(spark, same), ITEM, "category").where("category = 'c'").first().alpha is None
    assert {r.label for r in C.consensus(frame(spark, same), ITEM, "category").collect()} == {1}
