import random
from collections import Counter

import pandas as pd

from tidewright.llm import mapping as M

LIST = [
    (1, "episaoxetol 250 mg nasal spray", ["episaoxetol spray 250mg"]),
    (2, "episaoxetol 25 mg nasal spray", []),
    (3, "acute prostatic dysplasia", None),
    (4, "acute gastric dysplasia", []),
    (5, "thyroid ultrasound without contrast", ["thyroid US without contrast", "Thyroid US w/o contrast"]),
    (6, "lumcillin 40 mg tablet", ["lumcillin 40 mg tabs"]),
    (7, "housing instability", []),
    (8, "lumpecillin serum level", []),
    (9, None, ["x"]),
]


def table(rows, block=1000):
    """A function from a value to its canonical id, over a list held in blocks."""
    rows = [r for r in rows if r[1]]
    said = M.said_udf.func(pd.Series([r[1] for r in rows]), pd.Series([r[2] for r in rows]))
    learned = Counter(p for x in said["learned"] for p in x)
    known = M.Vocabulary({t for x in said["listed"] for t in x}, {tuple(p.split(" ")): n for p, n in learned.items() if n > 1}, M.ABBREVIATIONS, M.FILLERS)
    blocks = [M.Block(rows[i : i + block], known) for i in range(0, len(rows), block)]

    def run(text):
        value = M.Value(text, known)
        for b in blocks:
            b.visit(value)
        return value.decided(known)

    return run


def one(text):
    return table(LIST)(text)


def test_values():
    assert one("EPISAOXETOL_250_MG  nasal spray") == 1
    assert one("nasal spray, episaoxetol 25.0 (MG)") == 2
    assert one("epsiaoxetol 250mg nasl spray - per pt") == 1
    assert one("pt takes episaoxetol 25 mg nasal spray") == 2
    assert one("episaoxetol 2.5 mg nasal spray") == 0
    assert one("episaoxetol 250 mg") == 1
    assert one("Dysplasia prostatic, acute") == 3 and one("ac gastirc dysplasia") == 4
    assert one("severe gastric dysplasia") == 0
    assert one("Thyroid U/S without contrast") == 5
    assert one("lumcillin 40 milligrams tab") == 6 and one("lumcillin 40 mg injection") == 0
    assert one("hous1ng instability") == 0 and one("housing instabilty (confirmed)") == 7
    assert one("lost parcel near Tarnmere, May") == 0 and one("n/a") == 0 and one("???") == 0
    assert one("zerthimucin serum level") == 0


def test_typing_errors_against_the_list():
    rng = random.Random(2)
    names = {k: n for k, n, _ in LIST if n}
    run = table(LIST)
    hits = 0
    for _ in range(300):
        key, name = rng.choice(sorted(names.items()))
        words = name.split()
        i = max(range(len(words)), key=lambda j: len(words[j]))
        w = words[i]
        at = rng.randrange(1, len(w) - 1)
        words[i] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeiou") + w[at:], w[:at] + w[at + 1] + w[at] + w[at + 2 :]])
        hits += run(" ".join(words)) == key
    assert hits >= 297


def test_operator(spark, monkeypatch):
    entries = spark.createDataFrame([(1, "lumcillin 40mg tablet", 5, "z"), (2, None, 5, "z"), (3, "  \t", 5, "z"), (4, "as above", 5, None), (4, "as above", 5, None), (5, "x" * 500_000, 1, "z"), (6, "housing instability", 1, "z")], "entry_id bigint, item string, canonical_id int, variants string")
    listed = spark.createDataFrame(LIST, "canonical_id int, canonical_item string, variants array<string>")
    want = [(1, 6), (4, 0), (4, 0), (5, 0), (6, 7)]
    done = M.mapped(entries, listed, "item")
    assert sorted((r.entry_id, r.mapped_id) for r in done.collect()) == want and done.columns == [*entries.columns, "mapped_id"]
    assert {(r.value[:8], r.n_entries) for r in M.unmatched_report(done, "item").collect()} == {("as above", 2), ("xxxxxxxx", 1)}
    monkeypatch.setattr(M, "BLOCK", 3)
    assert sorted((r.entry_id, r.mapped_id) for r in M.mapped(entries, listed, "item").collect()) == want
    assert {r.mapped_id for r in M.mapped(entries, listed.limit(0), "item").collect()} == {0}
    assert M.mapped(entries.limit(0), listed, "item").count() == 0


def test_longest_mention_wins_and_ties_are_none():
    rows = [(1, "Insulin", []), (2, "Insulin glargine", []), (3, "Warfarin 5 mg tablet", []), (4, "gastric pain", []), (5, "gastric pair", []), (6, "knee pain", ["sore knee"]), (7, "sore knee", None)]
    for block in (1, 2, 1000):
        run = table(rows, block)
        assert run("insulin glargine, insulin") == 2 and run("insulin") == 1
        assert run("insulin glargine with warfarin") == 0  # another word of the list is left
        assert run("gastric pai") == 0  # a tie, in one block or in two
        assert run("sore knee") == 7  # an item's own name before the alias of another
        assert run("insulin; knee pain") == 6 and run("gastric pain") == 4


def test_blocks_change_nothing(spark):
    rng = random.Random(8)
    words = ["gastric", "renal", "acute", "chronic", "pain", "edema", "spray", "tablet", "5", "10", "mg", "zolvarin", "zolvarine"]
    listed = [(i, " ".join(rng.sample(words, rng.randrange(1, 5))), [" ".join(rng.sample(words, 2))] if i % 3 else None) for i in range(1, 60)]
    values = [" ".join(rng.choices([*words, "gastirc", "zolvarn", "today", "tab"], k=rng.randrange(1, 5))) for _ in range(300)]
    entries = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(1000 + i, values[0]) for i in range(1500)], "entry_id bigint, item string")
    frame = spark.createDataFrame(listed, "canonical_id int, canonical_item string, variants array<string>")
    got = [sorted((r.entry_id, r.mapped_id) for r in M.mapped(entries, frame, "item", block=b).collect()) for b in (7, 50_000)]
    assert got[0] == got[1] and len(got[0]) == 1800 and len({m for _, m in got[0]}) > 10
    run = table(listed)
    assert dict(got[0]) == {i: run(v) for i, v in enumerate(values)} | {1000 + i: run(values[0]) for i in range(1500)}
