import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as X
from tidewright.operators import fuzzy as Z


def test_similarity():
    assert Z.similarity("", "") == 1.0 and Z.similarity("a", "") == 0.0
    assert Z.similarity("knee pain", "pain knee") == pytest.approx(0.65 + 0.35 * 2 * 5 / 18, abs=0.05)
    rng = random.Random(1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = ("".join(rng.choices("abcd ", k=rng.randrange(12))) for _ in range(2))
        assert Z.common_subsequence(a, b) == slow(a, b)


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in Z.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert Z.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters(spark):
    rows = spark.createDataFrame([("knee pain chronic",), ("Knee  pain, chronic",), ("chronic knee pain",), ("hip fracture",), (None,), ("  ",), ("knee pain chronicc",)], "item string")
    got = {r.original: r.representative for r in Z.item_clusters(rows, "item", 85).collect()}
    assert set(got) == {"knee pain chronic", "Knee  pain, chronic", "knee pain chronicc"} and set(got.values()) == {"Knee  pain, chronic"}
    assert Z.item_clusters(rows, "item", 85, singletons=True).where("original = 'hip fracture'").count() == 1


def test_mapping(spark):
    mapping = spark.createDataFrame([("Aspirin", ["asa", "ASPIRIN TAB"]), ("Ibuprofen", None), ("X", ["asa "])], "canonical_item string, variants array<string>")
    rows = spark.createDataFrame([(1, " ASA "), (2, "ibuprofen "), (3, "other"), (4, None)], "id int, item string")
    got = {r.id: (r.standard, r.resolved) for r in Z.exact_mapping(rows, "item", mapping).collect()}
    assert got == {1: ("Aspirin", True), 2: ("Ibuprofen", True), 3: ("other", False), 4: (None, False)}
    assert [r.form for r in Z.mapping_conflicts(mapping).collect()] == ["asa"]


def test_fallback(spark):
    forms = spark.createDataFrame([("acute knee pain", "acute knee pain"), ("chronic hip cyst", "chronic hip cyst")], "form string, canonical string")
    rows = spark.createDataFrame([(1, "acute knee painn"), (2, "zzzz"), (3, None), (4, " ")], "id int, item string")
    got = {r.id: r.match for r in Z.fuzzy_fallback(rows, "item", "id", forms).collect()}
    assert got == {1: "acute knee pain", 2: None}
    spread = sorted((r.id, r.match, round(r.score, 9)) for r in Z.fuzzy_fallback(rows, "item", "id", forms, block=1).collect())
    assert spread == sorted((r.id, r.match, round(r.score, 9)) for r in Z.fuzzy_fallback(rows, "item", "id", forms).collect())
    rng = random.Random(1)
    many = [("".join(rng.choices("abcde ", k=rng.randrange(1, 14))).strip() or "a") for _ in range(150)]
    known = Z.Forms([(f, f, f) for f in many[:100]])
    for t in many[100:]:  # the bound loses nothing
        score, form = min((-Z.similarity(t, f), f) for f in many[:100])
        assert known.best(t)[:2] == (-score, form)
    matcher = Z.FuzzyMatcher([("acute knee pain", "A"), ("acute knee pain", "B")])
    assert matcher.match("acute knee pain") == ("A", 1.0) and matcher.match("unlike")[0] is None


def test_text(spark):
    df = spark.createDataFrame([("  (Knee) Pain! ",), ("Straße",), (None,), ("",)], "t string")
    got = df.select(X.trimmed(F.col("t")), X.bare_item(F.col("t")), X.match_form("t"), X.folded("t"), X.slug_key(F.col("t")), X.titled("t")).collect()
    assert tuple(got[0]) == ("(Knee) Pain!", "Knee) Pain", "(knee) pain!", "(knee) pain", "knee_pain", "  (Knee) Pain! ")
    assert got[1][2] == "strasse" and tuple(got[2]) == (None,) * 6 and got[3][4] == ""
    assert df.limit(1).select(X.slug_key(F.lit("2 Hip-Pain"))).first()[0] == "c_2_hip_pain"
    shown = spark.range(1).select(X.shown_p(F.lit(0.00001)), X.shown_p(F.lit(None).cast("double")), X.shown_number(F.lit(0.5))).first()
    assert tuple(shown) == ("< 0.0001", "N/A", "0.5000")
