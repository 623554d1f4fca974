import pytest

from tidewright.operators import cells as C
from tidewright.operators import reference as R

SCHEMA = "row_id int, patient string, item string, physician int, A double, note string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def aggregated(spark, rows, **more):
    return R.aggregate_observers(frame(spark, rows), ["patient", "item"], "physician", ["A"], "row_id", extra=["note"], **more).collect()


def test_two_observers(spark):
    got = aggregated(spark, [("1", "x", 2, 0.0, None), ("1", "x", 1, 1.0, "n")])
    assert [(r.A, r.physician_ids, r.note) for r in got] == [(0.5, [1, 2], "n")]


def test_whole_copies_collapse(spark):
    got = aggregated(spark, [("1", "x", 1, 0.0, None), ("1", "x", 2, 1.0, None)] * 2)
    assert [(r.A, r.physician_ids) for r in got] == [(0.5, [1, 2])]


def test_other_sizes_go_or_raise(spark):
    part = [("1", "x", 1, 0.0, None), ("1", "x", 2, 1.0, None), ("1", "x", 1, 0.0, None), ("2", "x", 1, 1.0, None)]
    assert aggregated(spark, part) == []
    with pytest.raises(ValueError):
        aggregated(spark, part, on_mismatch="error")


def test_missing_labels_and_null_keys(spark):
    got = {(r.patient, r.item): r.A for r in aggregated(spark, [("1", "x", 1, None, None), ("1", "x", 2, 1.0, None), (None, "x", 1, 1.0, None), ("3", "y", 1, None, None), ("3", "y", 2, None, None)])}
    assert got == {("1", "x"): 1.0, (None, "x"): 1.0, ("3", "y"): None}
    assert aggregated(spark, []) == []


def test_triplets(spark):
    a, b = frame(spark, [("1", "x", 1, 0.0, None)] * 2 + [(None, "x", 1, 0.0, None)]), frame(spark, [("1", "x", 1, 0.0, None), ("2", "x", 1, 0.0, None), (None, "x", 1, 1.0, None)])
    keys = ["patient", "physician", "item"]
    assert {(r.patient, r.side) for r in R.triplet_diff(a, b, keys).collect()} == {("2", "right")}
    assert {(r.patient, r.side, r.excess) for r in R.triplet_multiset_diff(a, b, keys).collect()} == {("1", "left", 1), ("2", "right", 1)}


def test_cells(spark):
    scores = spark.createDataFrame([(1, "m", "1", "x", "context_free", 0.4, None), (2, "m", "1", "x", "correct_context", 0.7, None), (3, "m", "1", "x", "shuffled_context", 0.9, None), (4, "m", "1", "x", "shuffled_context", 0.5, None), (5, "m", "1", "y", "context_free", 0.1, None)], "score_id int, model string, patient_id string, item_text string, score_condition string, A double, B double")
    reference = spark.createDataFrame([("1", "x", "A", 0.3, 0.5, 0.2), ("1", "y", "A", 0.5, 0.5, 0.0)], "patient_id string, item_text string, category string, survey double, interview double, delta double")
    got = {r.item_text: r for r in C.paired_cells(C.pivoted_scores(scores, ["A", "B"]), reference).collect()}
    assert got["x"].delta_llm_correct == pytest.approx(0.3) and got["x"].delta_llm_shuffled == pytest.approx(0.1) and got["x"].alignment_difference == pytest.approx(0.2)
    assert got["x"].llm_correct_changed_indicator and got["x"].physician_shift_indicator
    assert got["y"].delta_llm_correct is None and not got["y"].llm_correct_changed_indicator
    assert [r.item_text for r in C.valid_pairs(C.pivoted_scores(scores, ["A"]), True).collect()] == ["x"]
    assert C.unmatched_scores(C.pivoted_scores(scores, ["A", "B"]), reference).count() == 2


def test_shuffled_assignment(spark):
    pairs = frame(spark, [(str(p), f"i{i}", 1, 0.0, None) for p in range(6) for i in range(p + 1)])
    for weighting in ("patient", "pair"):
        got = R.shuffled_assignment(pairs, "patient", "item", 3, weighting).collect()
        assert len(got) == 21 and all(r.patient != r.context_entity for r in got)
    assert R.shuffled_assignment(frame(spark, [("1", "x", 1, 0.0, None)]), "patient", "item", 3).count() == 0
