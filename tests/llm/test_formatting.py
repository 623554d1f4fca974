import re

from tidewright.llm import formatting as D

SCHEMA = "row_id bigint, patient string, physician string, item string, diagnoses double, loaded_at int, k string, id string"
ARGS = {"id_col": "row_id", "texts": ["patient"], "lists": ["item"], "ignore": ["loaded_at"], "required": ["patient", "physician", "item"]}


def frame(spark, rows):
    return spark.createDataFrame([(*r, i, "k", "id") for i, r in enumerate(rows)], SCHEMA)


def bare(text):
    out = "".join(c for i, c in enumerate(text) if c.isalnum() or (not c.isspace() and 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit()))
    return out.lower()


def brute(rows):
    groups = {}
    for row_id, patient, physician, item, d in rows:
        if None in (patient, physician, item):
            continue
        parts = tuple(sorted(p for p in map(bare, re.split("[;|]", item)) if p))
        groups.setdefault((bare(patient), physician, parts, d), []).append(row_id)
    return groups


ROWS = [
    (1, "PT-101", "PH-1", "Drug 12.5 mg; oral; at night", 1.0),
    (2, "(pt 101)", "PH-1", "ORAL | drug  12.5mg|At Night", 1.0),
    (3, "pt.101", "PH-1", "oral;drug 1.25 mg;at night", 1.0),
    (4, "PT 101", "PH-1", "drug 125 mg; oral; at night", 1.0),
    (5, "PT-101", "PH-1", "\"Drug\" 12.5 mg;; oral; (at night).", 1.0),
    (6, "PT-101", "PH-1", "Drug 12.5 mg; oral; at night", None),
    (7, "PT-101.", "PH-1", "drug 12.5 mg; oral; at\tnight\n", None),
    (8, "PT-101", None, "Drug 12.5 mg; oral; at night", None),
    (9, None, "PH-1", "Drug 12.5 mg; oral; at night", 1.0),
    (10, "PT-101", "PH-1", None, 1.0),
    (11, "PT-101", "PH-1", "", 1.0),
    (12, "PT-101", "PH-1", " ; ", 1.0),
    (13, "PT-102", "PH-1", "Drug 12.5 mg; oral; at night", 1.0),
    (14, "PT-101", "PH-1", "self–reported; since 2009", 0.0),
    (15, "pt101", "PH-1", "Since 2009|self-reported", 0.0),
]


def links(df):
    return {(r.first_id, r.row_id) for r in D.copy_links(df, **ARGS).collect()}


def test_against_brute_force(spark):
    groups = brute(ROWS)
    assert links(frame(spark, ROWS)) == {(min(g), r) for g in groups.values() for r in g if r != min(g)}
    got = {(r.first_id, r.n_copies) for r in D.copies(frame(spark, ROWS), **ARGS).collect()}
    assert got == {(min(g), len(g)) for g in groups.values()}
    assert (1, 3) in got and (14, 2) in got and (11, 2) in got


def test_hot_key(spark, monkeypatch):
    rows = [(i, "PT-1" if i % 2 else "pt 1", "PH", "a; b" if i % 3 else "B|A", 1.0) for i in range(5000)] + [(10_000 + i, f"PT-{i}", "PH", "c", 0.0) for i in range(2, 2000)] + [(20_000, "pt-5", "PH", "C", 0.0)]
    got = links(frame(spark, rows))
    assert got == {(0, i) for i in range(1, 5000)} | {(10_005, 20_000)}
    assert {(r.first_id, r.n_copies) for r in D.copies(frame(spark, rows), **ARGS).where("n_copies > 1").collect()} == {(0, 5000), (10_005, 2)}


def test_empty_and_long(spark):
    assert links(frame(spark, [])) == set() and D.copies(frame(spark, []), **ARGS).count() == 0
    long = "word, " * 200_000
    assert links(frame(spark, [(2, "p", "h", long, 1.0), (1, "P", "h", long.upper(), 1.0)])) == {(1, 2)}
