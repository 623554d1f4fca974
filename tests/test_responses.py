import json

import pytest

from tidewright.operators import cv
from tidewright.operators import features as H
from tidewright.operators import responses as Q
from tidewright.operators import validate as V
from tidewright.sources import tables as T
from tidewright.streaming import responses as R

CLASSES = ["a", "b"]


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 0, "b": 1}', ({"a": 0.0, "b": 1.0}, None)),
        ('  ```json\n{"a": 0.5, "b": 0.25, "c": 9}\n```', ({"a": 0.5, "b": 0.25}, None)),
        ('{"a": 9} <think>which</think> {"a": 0.1, "b": 0.2} done', ({"a": 0.1, "b": 0.2}, None)),
        ('note {"a": 0.1, "b": 0.2, "s": "}{\\""} tail }', ({"a": 0.1, "b": 0.2}, None)),
        ('{"a": 0.1}', (None, "MissingKeyError")),
        ('{"a": true, "b": 0}', (None, "RangeError")),
        ('{"a": NaN, "b": 0}', (None, "RangeError")),
        ('{"a": 1.1, "b": 0}', (None, "RangeError")),
        ("[1]", (None, "ParseError")),
        ('{"a": 1', (None, "ParseError")),
        ("", (None, "ParseError")),
        (None, (None, "ParseError")),
    ],
)
def test_responses(text, want):
    assert Q.parse_response(text, CLASSES) == want


def test_builtin_scores(spark):
    df = spark.createDataFrame([(1, '{"a": 0.5, "b": 1}'), (2, '{"a": 0.5}'), (3, "no"), (4, None), (5, '{"a": null, "b": "x"}')], "id int, raw string")
    got = {r.id: (r.a, r.b, r.parse_error) for r in Q.json_scores(df, "raw", CLASSES).collect()}
    assert got == {1: (0.5, 1.0, None), 2: (0.5, None, "MissingKeyError"), 3: (None, None, "ParseError"), 4: (None, None, "ParseError"), 5: (None, None, None)}


def test_cache(spark):
    want = spark.createDataFrame([("1", "h1"), ("2", "h2"), ("3", "h3"), ("4", "h4")], "k string, h string")
    cache = spark.createDataFrame([("1", "h1", None), ("2", "old", None), ("3", "h3", "timeout")], "k string, h string, e string")
    assert {r.k: r.reason for r in Q.pending_calls(want, cache, ["k"], "e", "h").collect()} == {"2": "stale", "3": "failed", "4": "missing"}
    assert {r.k: r.status for r in Q.cache_status(want, cache, ["k"], "e").collect()} == {"1": "completed", "2": "completed", "3": "failed", "4": "pending"}


def test_failing_scorer_is_recorded(spark):
    def scorer(texts):
        raise RuntimeError("down")

    row = Q.score_calls(spark.createDataFrame([("p",)], "prompt string"), "prompt", scorer, 2).first()
    assert row.raw_text is None and row.error == "RuntimeError: down"


def test_stream(spark, tmp_path):
    rows = [{"k": "1", "at": "2024-01-01T00:00:00", "raw": '{"a": 0.5}'}, {"k": "1", "at": "2024-01-01T00:01:00", "raw": '{"a": 0.9}'}, {"k": "2", "at": "2024-01-01T00:02:00", "raw": "bad"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("k string, at timestamp, raw string").json(str(tmp_path / "in"))
    done = R.scored_stream(stream, "raw", ["a"], ["k"], "at")
    done.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r.k: (r.a, r.parse_error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"1", "2"} and got["1"][0] in (0.5, 0.9) and got["2"] == (None, "ParseError")


def test_folds(spark):
    rows = spark.createDataFrame([(f"p{i % 7}", i) for i in range(50)] + [(None, 99)], "p string, row int")
    for folds in (cv.leave_one_out(rows, "p"), cv.hash_folds(rows, "p", 3, 1), cv.group_folds(spark, [f"p{i}" for i in range(7)], 3, 1).withColumnRenamed("entity", "p")):
        got = folds.collect()
        assert len(got) == len({r.p for r in got}) == 7
        sizes = [sum(r.fold == k for r in got) for k in {r.fold for r in got}]
        assert max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError):
        cv.group_folds(spark, ["a"], 2, 1)
    assert [r.fold for r in cv.unfinished_folds(spark.createDataFrame([(0,), (1,)], "fold int"), spark.createDataFrame([(0,)], "fold int")).collect()] == [1]


def test_features(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [1.0, 0.0]), (2, [0.0, 0.0], [2.0, 2.0])], "id int, item array<double>, context array<double>")
    assert [r[0] for r in df.select(H.l2_normalised("item")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(H.fused("item", "context", "4_vector")).first()[0] == [3.0, 4.0, 1.0, 0.0, 3.0, 0.0, 2.0, 4.0]
    with pytest.raises(ValueError):
        H.fused("item", "context", "5d")
    import numpy as np

    x = np.random.default_rng(0).normal(size=(200, 4)) @ np.diag([3, 2, 1, 0.5])
    done, _ = H.whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "v", 3)
    z = np.array([r.components for r in done.collect()])
    assert np.allclose(np.cov(z.T, ddof=0), np.eye(3), atol=1e-6)


def test_leakage_and_rows(spark):
    pairs = spark.createDataFrame([("1", "Knee Pain"), ("1", ""), ("2", "x"), ("3", None)], "patient_id string, item_text string")
    contexts = spark.createDataFrame([("1", "fine", ["old KNEE pain"]), ("2", None, None)], "patient_id string, summary string, labs array<string>")
    assert [tuple(r) for r in V.label_leakage(pairs, contexts).collect()] == [("1", "Knee Pain", "labs")]


def test_sources(spark, tmp_path):
    spark.createDataFrame([("1", "x", "1")], "Patient string, Item string, A string").write.parquet(str(tmp_path / "train.parquet"))
    got = T.load_sheets(spark, str(tmp_path), ["train"], {"A": "double"})["train"]
    assert dict(got.dtypes)["A"] == "double"
    with pytest.raises(T.SheetNotFoundError, match="train"):
        T.load_sheets(spark, str(tmp_path), ["test"])
    with pytest.raises(ValueError):
        T.load_sheets(spark, str(tmp_path), [])
    with pytest.raises(ValueError, match="B"):
        T.require_columns(got, ["A", "B"])
    path = tmp_path / "contexts.json"
    path.write_text(json.dumps({"1": {"summary": "one", "labs": ["a", "b"]}, "2": {"labs": []}}))
    records = {r.patient_id: r.fields for r in T.load_context_records(spark, str(path)).collect()}
    assert records == {"1": {"summary": ["one"], "labs": ["a", "b"]}, "2": {"labs": []}}
    for model in ("org__m", "_skip", "half__m"):
        for c in T.CONDITIONS[: 2 if model == "half__m" else 3]:
            (tmp_path / "s" / model).mkdir(parents=True, exist_ok=True)
            (tmp_path / "s" / model / f"{c}.csv").write_text("patient_id,item_text,diagnoses\n1,x,0.5\n1,y,bad\n")
    scores = T.load_scores_dir(spark, str(tmp_path / "s"), ["diagnoses"])
    assert {(r.model, r.condition, r.item_text, r.diagnoses) for r in scores.collect()} == {("org/m", c, i, v) for c in T.CONDITIONS for i, v in (("x", 0.5), ("y", None))}
    with pytest.raises(ValueError):
        T.load_scores(spark, {"context_free": "x"})
    made = T.synthetic_ratings(spark)
    assert made.count() == 6 * 16 * 2 and made.exceptAll(T.synthetic_ratings(spark)).isEmpty()
    T.write_scores(scores.withColumnRenamed("condition", "score_condition"), str(tmp_path / "out"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "r.md").write_text("x")
    assert T.write_bundle(str(tmp_path / "b"), str(tmp_path / "b.zip")) == ["r.md"]
    assert len(T.run_manifest({"a": 1}, [str(tmp_path / "b")])["inputs"]) == 1


def test_routing_reads_every_class(spark, tmp_path):
    from tidewright.plans import catalogue

    classes = T.CLASSES
    row = lambda i, **odd: (i, "context_free", *(odd.get(c, 0.5) for c in classes))
    rows = [row(1), *(row(100 + k, **{c: v}) for k, (c, v) in enumerate((c, v) for c in classes for v in (1.5, None, float("nan")))), row(11), row(26)]
    wanted = {1: None, 11: "LLMCallFailed", 26: "MissingKeyError"}
    schema = "score_id bigint, score_condition string, " + ", ".join(f"{c} double" for c in classes)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "scores.parquet"))
    got = {r.score_id: r.error_type for r in catalogue.queries()["j4_error_routing_all"](spark, str(tmp_path)).collect()}
    for i in (r[0] for r in rows):
        error = "LLMCallFailed" if i % 11 == 0 else "MissingKeyError" if i % 13 == 0 else "RangeError"
        assert got[i] == wanted.get(i, error)
    values = {r.score_id: r for r in catalogue.queries()["j1_json_scores_all"](spark, str(tmp_path)).collect()}
    assert [values[1][c] for c in classes] == [0.5] * 10 and values[26].parse_error == "MissingKeyError"


def test_cache_query_takes_all_responses(spark, tmp_path):
    from tidewright.plans import catalogue

    rows = [(i, "m", "1", f"i{i}", "context_free", None, 0.5, 0.5) for i in (1, 5, 10, 11)]
    spark.createDataFrame(rows, "score_id bigint, model string, patient_id string, item_text string, score_condition string, scored_at timestamp, diagnoses double, other double").write.parquet(str(tmp_path / "scores.parquet"))
    assert {r.score_id for r in catalogue.queries()["s12_without_failed_all"](spark, str(tmp_path)).collect()} == {1, 5, 10}
