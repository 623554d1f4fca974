import random

import pytest

from tidewright.llm import mixing as X

pt = pytest.importorskip("public_tokenizers")
VOCABULARY, PATTERN = str(pt.path("byte_bpe_50k.tiktoken")), pt.PATTERN
SCHEMA = "doc_id bigint, text string, source string, doc_kind string, rate double, name string, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def frames(spark, docs, targets):
    return spark.createDataFrame([(*d, "note", 0.1, "x", "y") for d in docs], SCHEMA), spark.createDataFrame(targets, TARGETS)


def mix(spark, docs, targets, **more):
    d, t = frames(spark, docs, targets)
    mixed = X.mixture(d, t, VOCABULARY, PATTERN, **more)
    return mixed, {r.source: r for r in X.mixture_report(mixed, t).collect()}


def corpus():
    rng = random.Random(1)
    words = {"a": ["river", "boat", "fish"], "b": ["court", "judge", "law"], "c": ["atom", "field", "wave"], "d": ["song", "drum"]}
    docs = []
    for s, n in (("a", 400), ("b", 120), ("c", 12), ("d", 60)):
        for _ in range(n):
            docs.append((len(docs), " ".join(rng.choices(words[s], k=rng.randrange(5, 40))), rng.choice([s, f" {s.upper()}"])))
    docs += [(len(docs) + i, " ".join(rng.choices(words["c"], k=20)), None) for i in range(10)]
    docs += [(5000, None, "a"), (5001, "", "b")]
    return docs


def test_shares_are_met_within_repeats(spark):
    docs = corpus()
    mixed, report = mix(spark, docs, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("e", 0.05, 2)])
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert report[s].actual_share == pytest.approx(share / 0.95, abs=0.02)
        assert report[s].most_copies <= report[s].max_repeats
    assert report["e"].actual_share == 0 and "d" not in report
    rows = mixed.collect()
    assert not {r.doc_id for r in rows} & {5000, 5001} and all(r.n_copies >= 1 for r in rows)
    assert {r.source for r in rows} <= {"a", "b", "c", None}


def test_larger_total_uses_documents_without_source(spark):
    docs = corpus()
    _, small = mix(spark, docs, [("a", 0.5, 1), ("c", 0.5, 2)])
    mixed, large = mix(spark, docs, [("a", 0.5, 1), ("c", 0.5, 2)], total=5000.0)
    assert abs(small["c"].own_share - 0.5) < 0.05
    unlabelled = [r for r in mixed.collect() if r.source is None]
    assert unlabelled and all(r.n_copies == 1 for r in unlabelled)
    order = ["a", "c"]
    assert all(max(range(2), key=lambda i: r.membership[i]) == order.index("c") for r in unlabelled)
    assert large["c"].actual_share > large["c"].own_share


def test_token_counts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    own = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["hello world", "<|endoftext|>", "naïve 10 µg\n\n", "x" * 20_000]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    got = [r[0] for r in df.select(X.token_counts(df["text"], VOCABULARY, PATTERN)).collect()]
    assert got == [*(len(own.encode_ordinary(t)) for t in texts), 0, 0]


def test_empty_tables(spark):
    mixed, report = mix(spark, [], [("a", 1.0, 1)])
    assert mixed.count() == 0 and report["a"].actual_share == 0
    assert mix(spark, corpus()[:5], [])[0].count() == 0


def test_registered_query_mixes_documents_without_source(spark, tmp_path):
    from tidewright.llm import queries

    d, t = frames(spark, corpus(), [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    t.write.parquet(str(tmp_path / "mix_targets.parquet"))
    rows = queries.p8_mixture(spark, str(tmp_path)).collect()
    report = {r.source: r for r in queries.p8_report(spark, str(tmp_path)).collect()}
    assert sum(r.source is None for r in rows) == 10
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert report[s].actual_share == pytest.approx(share, abs=0.02)
    assert report["c"].own_share < report["c"].actual_share
