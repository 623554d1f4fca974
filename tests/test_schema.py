import pytest
from pyspark.sql import functions as F

from tidewright import schema as S
from tidewright.functions import text as X
from tidewright.operators import endpoints as E
from tidewright.operators import features as H
from tidewright.operators import fuzzy as Z
from tidewright.plans import report


def test_label_space(spark):
    space = S.LabelSpace.of(["a", "b_c"])
    assert space.keys == ["a", "b_c"] and space.key_of("b c") == "b_c" and space.table(spark).count() == 2
    for bad in ([], ["a", "a"], ["A"], ["1a"]):
        with pytest.raises(ValueError):
            S.LabelSpace.of(bad)
    with pytest.raises(KeyError):
        space.key_of("c")


def test_columns(spark):
    df = spark.createDataFrame([("1", "o", "x", "0.5", "bad")], "Patient string, Obs string, Item string, Diagnoses string, other string")
    cols = S.ColumnMap.from_config({"patient": "Patient", "observer": "Obs", "item": "Item", "unknown": 1})
    assert cols.renamed(df).columns[:3] == ["patient", "physician", "item"]
    with pytest.raises(ValueError):
        S.ColumnMap().renamed(df.drop("Obs"))
    assert S.with_known_names(df).columns == ["patient_id", "Obs", "item_text", "diagnoses", "other"]
    assert tuple(S.numbers_or_zero(df, ["Diagnoses", "other"]).select("Diagnoses", "other").first()) == (0.5, 0.0)


def test_folds_and_registries(spark):
    rows = spark.createDataFrame([(f"p{i}",) for i in range(6)], "p string")
    assert S.FoldScheme().folds(rows, "p").select("fold").distinct().count() == 6
    assert S.FoldScheme("group_kfold", 3).folds(rows, "p").select("fold").distinct().count() == 3
    for bad in (("x", 3), ("group_kfold", 1)):
        with pytest.raises(ValueError):
            S.FoldScheme(*bad)
    assert S.endpoint("context_sensitivity") is E.context_sensitivity
    with pytest.raises(KeyError, match="context_specificity"):
        S.endpoint("x")
    registry = S.Registry()
    registry.add("a", dict)
    assert registry.get("a") is dict
    with pytest.raises(KeyError):
        registry.get("b")


def test_flags_and_report(spark):
    rows = [("a", 0.001, 0.1, 0.2), ("b", 0.2, -0.1, 0.2), ("c", 0.2, 0.01, 0.04), ("d", 0.2, 0.01, 0.05), ("e", None, 0.1, 0.2), ("f", 0.2, None, 0.2)]
    df = spark.createDataFrame(rows, "model string, s double, low double, mean_alignment_difference double")
    out = df.withColumn("flag", E.interpretation_flag(F.col("s"), F.col("low"), F.col("mean_alignment_difference")))
    flags = {r.model: r.flag.split("_")[0] for r in out.collect()}
    assert flags == {"a": "no", "b": "nonspecific", "c": "modest", "d": "strong", "e": "failed", "f": "failed"}
    text = report.endpoint_report(out, E.model_ranking(out))
    assert "| a | 0.0010 |" in text and "N/A" in text and "- d: The right context" in text


def test_small_helpers(spark):
    df = spark.createDataFrame([("p1", ["a", "b"], None)], "p string, x array<string>, y array<string>")
    assert df.select(X.context_line({"x": F.col("x"), "y": F.col("y")})).first()[0] == "x: a, b; y: "
    assert df.select(X.context_block({"x": F.col("x"), "y": F.col("y")})).first()[0] == "[X]\n- a\n- b"
    assert df.select(H.one_hot("p", ["p0", "p1"])).first()[0] == [0.0, 1.0]
    assert [tuple(r) for r in Z.index_map(spark.range(3).withColumnRenamed("id", "row"), "row", {1: "one", "1": "other", "2": "two", "02": "x"}).orderBy("row").collect()] == [(0, None), (1, "one"), (2, "two")]
