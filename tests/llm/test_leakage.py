import random

import numpy as np

from tidewright.llm import leakage as K


def frames(spark, docs, evals):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").selectExpr("*", "1 as eval_id", "'x' as n_words")
    e = spark.createDataFrame([(100 + i, "val", t) for i, t in enumerate(evals)], "eval_id bigint, split string, text string")
    return d, e


def brute(docs, evals, least=12):
    """Longest run of common words for every passage and document."""
    out = {}
    for i, e in enumerate(evals):
        for j, d in enumerate(docs):
            if not e or not d:
                continue
            a, b = K.words(e), K.words(d)
            best = 0
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                out[100 + i, j] = best
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    evals = [" ".join(rng.choices(vocabulary, k=rng.randrange(8, 40))) for _ in range(12)] + [None, "", "too short"]
    docs = []
    for _ in range(40):
        text = rng.choices(vocabulary + [f"other{i}" for i in range(50)], k=30)
        e = rng.choice(evals[:12]).split()
        start = rng.randrange(max(1, len(e) - 12))
        cut = e[start : start + rng.choice([5, 11, 12, 13, 30])]
        docs.append(" ".join(text[:10] + cut + text[10:]))
    docs += [None, "", docs[0], docs[3].upper().replace(" ", "\n"), docs[5].replace("w", "w​"), ", ".join(docs[7].split())]
    d, e = frames(spark, docs, evals)
    got = {(r.eval_id, r.doc_id): r.n_words for r in K.leaks(d, e).collect()}
    assert got == brute(docs, evals)


def test_no_match_across_documents_and_positions(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    words = passage.split()
    d, e = frames(spark, [" ".join(words[:10]), " ".join(words[10:]), "before it " + passage + " after"], [passage])
    got = K.leaks(d, e).collect()
    assert [(r.eval_id, r.doc_id, r.n_words, r.eval_at, r.doc_at) for r in got] == [(100, 2, 20, 1, 3)]


def test_reports_and_removal(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    d, e = frames(spark, [passage, "other", passage + " more", None], [passage, "unseen " * 12])
    found = K.leaks(d, e)
    assert sorted(r.doc_id for r in K.without_leaks(d, found).collect()) == [1, 3]
    assert sorted((r.eval_id, r.n_docs, r.longest) for r in K.leaked_items(e, found).collect()) == [(100, 2, 12), (101, 0, 0)]


def test_empty_long_and_repeated(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    d, e = frames(spark, [], [passage])
    assert K.leaks(d, e).count() == 0
    d, e = frames(spark, [passage], [])
    assert K.leaks(d, e).count() == 0
    long = ("filler " * 300_000) + passage
    d, e = frames(spark, [long, long], [passage, passage])
    assert sorted((r.eval_id, r.doc_id) for r in K.leaks(d.union(d), e).collect()) == [(100, 0), (100, 1), (101, 0), (101, 1)]


def test_passages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_WORDS", 20)
    monkeypatch.setattr(K, "HITS", 3)
    texts = [" ".join(f"q{i}x{j}" for j in range(12)) for i in range(5)]
    d, e = frames(spark, texts, texts)
    assert sorted((r.eval_id, r.doc_id) for r in K.leaks(d, e).collect()) == [(100 + i, i) for i in range(5)]


def test_suffixes_in_their_whole_order():
    rng = np.random.default_rng(3)
    runs = [rng.integers(1, 4, rng.integers(1, 30)).astype(np.uint64) for _ in range(20)]
    runs += [runs[0], runs[1]]  # repeated runs
    tokens = np.concatenate([x for r in runs for x in (r, np.zeros(1, np.uint64))])
    array = K.SuffixArray(tokens)
    suffix = lambda i: tokens[i : i + array.left[i]].tolist()
    listed = [suffix(i) for i in array.at]
    assert listed == sorted(listed) and len(listed) == sum(map(len, runs))
    heads = array.coded(np.array([[1, 2, 3], [3, 3, 3], [2, 1, 1]], np.uint64))
    for head, a, b in zip(([1, 2, 3], [3, 3, 3], [2, 1, 1]), *array.range(heads), strict=True):
        assert [s[:3] == head for s in listed] == [a <= i < b for i in range(len(listed))]


def test_boilerplate_shared_by_many_passages(spark, monkeypatch):
    """Places are followed a few at a time; a passage that stands in every document is found in each."""
    monkeypatch.setattr(K, "HITS", 7)
    boiler = " ".join(f"b{i}" for i in range(14))
    texts = [f"{boiler} own{i} tail{i}" for i in range(12)]
    d, e = frames(spark, texts, texts)
    got = {(r.eval_id, r.doc_id): r.n_words for r in K.leaks(d, e).collect()}
    assert got == brute(texts, texts) and len(got) == 144
