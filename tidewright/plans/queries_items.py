"""Item mapping, fuzzy clustering, responses, prompts, vectors and models."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewright.functions import text as X
from tidewright.operators import agreement as G
from tidewright.operators import cv
from tidewright.operators import features as H
from tidewright.operators import fuzzy as Z
from tidewright.operators import responses as Q
from tidewright.operators import validate as V
from tidewright.plans.catalogue import entry
from tidewright.plans.queries_summary import _FORMS, _STD
from tidewright.plans.views import cells, sheet, sql
from tidewright.sources.tables import CLASSES, CONTEXT_FIELDS, table

_TRIM = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


@entry(f"with {_FORMS}, {_STD} select entry_id, resolved, standard from std")
def j7_exact_mapping(spark, sf):
    return Z.exact_mapping(table(spark, sf, "item_entries"), "item", table(spark, sf, "item_mapping")).select("entry_id", "resolved", "standard")


@entry(f"select form, count(distinct canonical) as n_items from (select lower({_TRIM.format('unnest(variants)')}) as form, lower({_TRIM.format('canonical_item')}) as canonical from item_mapping) group by form having count(distinct canonical) > 1")
def j7_mapping_conflicts(spark, sf):
    return Z.mapping_conflicts(table(spark, sf, "item_mapping"))


@entry(sql(f"select row_id, case when k.item is null then 'novel' else 'repeated' end as stratum from rv r left join (select distinct lower(item) as item from rv where sheet = 'train' and item is not null) k on k.item = lower(r.item) where r.sheet = 'test'", "rv"))
def j10_stratum(spark, sf):
    return Z.strata(sheet(spark, sf, "test"), "item", sheet(spark, sf, "train").select("item")).select("row_id", "stratum")


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(original), '[/\\\\,;]', ' ', 'g'), '[^a-z0-9_\\s()\\-]', '', 'g'), '\\s+', ' ', 'g'))"
_ITEMS = f"items as (select original, {_NORM} as norm from (select distinct {_TRIM.format('canonical_item')} as original from item_mapping where canonical_item is not null) where {_NORM} <> '')"
_KEYS = """tok as (select original, norm, regexp_extract_all(norm, '[A-Za-z0-9_]+') as t, replace(norm, ' ', '') as packed from items),
stop as (select token from (select original, unnest(list_distinct(t)) as token from tok) group by token having count(*) > greatest(2, ceil(0.25 * (select count(*) from items)))),
keys as (select distinct original, key from (
  select original, 'p:' || substr(norm, 1, 3) as key from tok union all select original, 'l:' || (length(norm) // 5) from tok union all select original, 'f:' || t[1] from tok union all select original, 's:' || list_sort(t)[1] from tok
  union all select original, 'g:' || substr(packed, cast(i as bigint), 3) from (select original, packed, unnest(range(1, length(packed) - 1)) as i from tok where length(packed) >= 3)
  union all select original, 't:' || token from (select original, unnest(list_distinct(t)) as token from tok) where length(token) >= 3 and token not in (select token from stop)) where key is not null),
small as (select k.* from keys k join (select key from keys group by key having count(*) between 2 and 200) b on b.key = k.key)"""


def _canonical(spark, sf):
    return Z.distinct_items(table(spark, sf, "item_mapping"), "canonical_item")


@entry(f"with {_ITEMS}, {_KEYS} select distinct least(a.original, b.original) as item_a, greatest(a.original, b.original) as item_b from small a join small b on a.key = b.key and a.original < b.original")
def j9_candidate_pairs(spark, sf):
    items = _canonical(spark, sf)
    name = lambda s: items.select(F.col("id").alias(s), F.col("original").alias(f"item_{s}"))
    pairs = Z.candidate_pairs(items).join(name("a"), "a").join(name("b"), "b")
    return pairs.select(F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"))


@entry(f"with {_ITEMS}, {_KEYS} select token, df from (select token, count(*) as df from (select original, unnest(list_distinct(t)) as token from tok) group by token) where token in (select token from stop)")
def t9_stop_tokens(spark, sf):
    return Z.stop_tokens(_canonical(spark, sf))


@entry(f"with {_ITEMS}, {_KEYS} select original, key from keys")
def t8_block_keys(spark, sf):
    items = _canonical(spark, sf)
    return Z.block_keys(items).distinct().join(items.select("id", "original"), "id").select("original", "key")


@entry(f"with {_ITEMS}, {_KEYS} select original, norm, array_to_string(list_sort(t), ' ') as sorted_tokens from tok")
def t3_t4_normal_forms(spark, sf):
    return _canonical(spark, sf).select("original", "norm", X.token_sort(F.col("norm")).alias("sorted_tokens"))


_EDGE = """edges as (select distinct a.patient as x, b.patient as y from (select distinct patient, item from rv where sheet = 'train' and patient is not null and item is not null) a join (select distinct patient, item from rv where sheet = 'train' and patient is not null and item is not null) b on a.item = b.item and a.patient <> b.patient)"""


@entry(sql(f""", {_EDGE}, cc(node, component) using key (node) as (select x as node, min(least(x, y)) as component from edges group by x union select e.y, min(c.component) from cc c join edges e on e.x = c.node join recurring.cc k on k.node = e.y where c.component < k.component group by e.y) select node, component from cc""", "rv", recursive=True))
def g1_components(spark, sf):
    rows = sheet(spark, sf, "train").where("patient is not null and item is not null").select("patient", "item").distinct()
    # patients of an item are tied through the smallest of them, so a frequent item gives no pairs
    least = rows.groupBy("item").agg(F.min("patient").alias("b"))
    edges = rows.join(least, "item").where("patient <> b").select(F.col("patient").alias("a"), "b").distinct()
    return Z.connected_components(edges)


@entry()
def g2_clusters(spark, sf):
    """Clusters of similar spellings among the entries as typed."""
    return Z.item_clusters(table(spark, sf, "item_entries").where("not item_json_resolved"), "item", 85)


@entry()
def g4_fuzzy_fallback(spark, sf):
    """Unresolved entries against the list's forms."""
    rows = table(spark, sf, "item_entries").where("not item_json_resolved")
    return Z.fuzzy_fallback(rows, "item", "entry_id", Z.mapping_forms(table(spark, sf, "item_mapping")))


_CALLS = "calls as (select distinct model, patient_id, item_text, score_condition from scores)"
_RAW = "'{\"diagnoses\": ' || coalesce(cast(diagnoses as varchar), 'null') || ', \"other\": ' || coalesce(cast(other as varchar), 'null') || '}'"


def _responses(spark, sf):
    """Scores as raw answers; one in eleven calls failed, one in thirteen answers lacks a key."""
    s = table(spark, sf, "scores")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    full = F.concat(F.lit('{"diagnoses": '), number("diagnoses"), F.lit(', "other": '), number("other"), F.lit("}"))
    part = F.concat(F.lit('{"diagnoses": '), number("diagnoses"), F.lit("}"))
    return s.select("score_id", "model", "patient_id", "item_text", "score_condition", "scored_at", F.when(F.col("score_id") % 13 == 0, part).otherwise(full).alias("raw_text"), F.when(F.col("score_id") % 11 == 0, "timeout").alias("error"))


_RESP = "resp as (select score_id, model, patient_id, item_text, score_condition, scored_at, case when score_id % 11 = 0 then 'timeout' end as error, score_id % 13 = 0 as partial_, diagnoses, other from scores)"


@entry(f"with {_RESP} select score_id, diagnoses, case when partial_ then null else other end as other, case when partial_ then 'MissingKeyError' end as parse_error from resp", "diagnoses other")
def j1_json_scores(spark, sf):
    return Q.json_scores(_responses(spark, sf), "raw_text", ["diagnoses", "other"]).select("score_id", "diagnoses", "other", "parse_error")


@entry(f"with {_RESP} select score_id, case when error is not null then 'LLMCallFailed' when partial_ then 'MissingKeyError' when diagnoses is null or other is null or diagnoses > 1 or other > 1 or diagnoses < 0 or other < 0 then 'RangeError' end as error_type from resp")
def j4_error_routing(spark, sf):
    done = Q.parsed(_responses(spark, sf), "raw_text", ["diagnoses", "other"])
    return Q.route_errors(done, "error", "parse_error", "score_condition").select("score_id", "error_type")


def _whole_responses(spark, sf):
    """Scores of all classes as raw answers; one in eleven calls failed, one in thirteen answers lacks its last key."""
    s = table(spark, sf, "scores")
    part = lambda c: F.concat(F.lit(f'"{c}": '), F.coalesce(F.when(F.isnan(c), "NaN").otherwise(F.col(c).cast("string")), F.lit("null")))
    answer = lambda names: F.concat(F.lit("{"), F.concat_ws(", ", *map(part, names)), F.lit("}"))
    return s.select("score_id", "score_condition", F.when(F.col("score_id") % 13 == 0, answer(CLASSES[:-1])).otherwise(answer(CLASSES)).alias("raw_text"), F.when(F.col("score_id") % 11 == 0, "timeout").alias("error"))


@entry(f"select score_id, {', '.join(CLASSES[:-1])}, case when score_id % 13 = 0 then null else {CLASSES[-1]} end as {CLASSES[-1]}, case when score_id % 13 = 0 then 'MissingKeyError' end as parse_error from scores", " ".join(CLASSES))
def j1_json_scores_all(spark, sf):
    return Q.json_scores(_whole_responses(spark, sf), "raw_text", CLASSES).select("score_id", *CLASSES, "parse_error")


_OUT = " or ".join(f"{c} is null or isnan({c}) or {c} < 0 or {c} > 1" for c in CLASSES)


@entry(f"select score_id, case when score_id % 11 = 0 then 'LLMCallFailed' when score_id % 13 = 0 then 'MissingKeyError' when {_OUT} then 'RangeError' end as error_type from scores")
def j4_error_routing_all(spark, sf):
    done = Q.parsed(_whole_responses(spark, sf), "raw_text", CLASSES)
    return Q.route_errors(done, "error", "parse_error", "score_condition").select("score_id", "error_type")


_KEYC = "model, patient_id, item_text, score_condition"
_CACHE = f"{_RESP}, cache as (select * from (select *, row_number() over (partition by {_KEYC} order by score_id desc) as rn from resp where score_id % 5 <> 0) where rn = 1)"


@entry(f"with {_CACHE}, want as (select distinct {_KEYC} from resp) select w.*, case when c.score_id is null then 'pending' when c.error is null then 'completed' else 'failed' end as status from want w left join cache c on c.model = w.model and c.patient_id = w.patient_id and c.item_text = w.item_text and c.score_condition = w.score_condition")
def s11_cache_pending(spark, sf):
    rows, keys = _responses(spark, sf), _KEYC.split(", ")
    return Q.cache_status(rows, Q.cache_latest(rows.where("score_id % 5 <> 0"), keys, "score_id"), keys, "error")


@entry(f"with {_CACHE} select {_KEYC}, score_id from cache where error is null")
def s12_without_failed(spark, sf):
    rows, keys = _responses(spark, sf), _KEYC.split(", ")
    return Q.without_failed(Q.cache_latest(rows.where("score_id % 5 <> 0"), keys, "score_id"), "error").select(*keys, "score_id")


@entry(f"with {_CACHE.replace(' where score_id % 5 <> 0', '')} select {_KEYC}, score_id from cache where error is null")
def s12_without_failed_all(spark, sf):
    rows, keys = _responses(spark, sf), _KEYC.split(", ")
    return Q.without_failed(Q.cache_latest(rows, keys, "score_id"), "error").select(*keys, "score_id")


_HASH = "substr(sha256(item_text || '|' || score_condition || case when patient_id like '%7' then '|new' else '' end), 1, 16)"


@entry(f"with {_CACHE}, want as (select distinct {_KEYC}, {_HASH} as prompt_hash from resp), j as (select w.*, c.score_id, c.error, substr(sha256(w.item_text || '|' || w.score_condition), 1, 16) as old from want w left join cache c on c.model = w.model and c.patient_id = w.patient_id and c.item_text = w.item_text and c.score_condition = w.score_condition) select * from (select {_KEYC}, prompt_hash, case when score_id is null then 'missing' when error is not null then 'failed' when prompt_hash <> old then 'stale' end as reason from j) where reason is not null")
def j6_stale_calls(spark, sf):
    rows, keys = _responses(spark, sf), _KEYC.split(", ")
    body = lambda extra: X.digest(F.concat(F.concat_ws("|", "item_text", "score_condition"), extra))
    want = rows.select(*keys).distinct().withColumn("prompt_hash", body(F.when(F.col("patient_id").endswith("7"), "|new").otherwise("")))
    cache = Q.cache_latest(rows.where("score_id % 5 <> 0"), keys, "score_id").withColumn("prompt_hash", body(F.lit("")))
    return Q.pending_calls(want, cache, keys, "error", "prompt_hash")


@entry(f"with {_CALLS} select *, {', '.join(f'0.5 as {c}' for c in CLASSES)} from calls", " ".join(CLASSES))
def j5_dry_run(spark, sf):
    return Q.dry_run(table(spark, sf, "scores").select("model", "patient_id", "item_text", "score_condition").distinct(), CLASSES)


@entry()
def j7_batch_calls(spark, sf):
    """Prompts through a pluggable scorer of batches."""
    answer = json.dumps({c: 0.5 for c in CLASSES})
    calls = table(spark, sf, "scores").select("item_text").distinct().withColumn("prompt", X.prompt(F.col("item_text"), CLASSES))
    done = Q.parsed(Q.score_calls(calls, "prompt", lambda texts: [answer] * len(texts)), "raw_text", CLASSES)
    return done.select("item_text", F.size("scores").alias("n_scores"), "parse_error")


@entry("select score_id, substr(sha256(item_text), 1, 12) as item_hash, substr(sha256(model || '|' || patient_id || '|' || item_text), 1, 16) as call_hash, replace(model, '/', '__') as slug from scores")
def t13_prompt_hash(spark, sf):
    return table(spark, sf, "scores").select("score_id", Q.cache_key("item_text").alias("item_hash"), X.digest(F.concat_ws("|", "model", "patient_id", "item_text")).alias("call_hash"), X.model_slug(F.col("model")).alias("slug"))


_SHORT = CLASSES[:3]
_SKEL = "{" + ", ".join(f'"{c}": 0.0' for c in _SHORT) + "}"


@entry("select distinct item_text, 'Score the item below for three classes, each from 0 to 1.' || chr(10) || chr(10) || '" + "' || chr(10) || '".join(f"- {c}" for c in _SHORT) + "' || chr(10) || chr(10) || 'Item: ' || item_text || chr(10) || chr(10) || 'Answer with this JSON only: " + _SKEL + "' as prompt from scores")
def t16_prompt_render(spark, sf):
    return table(spark, sf, "scores").select("item_text").distinct().withColumn("prompt", X.prompt(F.col("item_text"), _SHORT))


_SKEL_ALL = "{" + ", ".join(f'"{c}": 0.0' for c in CLASSES) + "}"


@entry("select distinct item_text, 'Score the item below for ten classes, each from 0 to 1.' || chr(10) || chr(10) || '" + "' || chr(10) || '".join(f"- {c}" for c in CLASSES) + "' || chr(10) || chr(10) || 'Item: ' || item_text || chr(10) || chr(10) || 'Answer with this JSON only: " + _SKEL_ALL + "' as prompt from scores")
def t16_prompt_render_all(spark, sf):
    return table(spark, sf, "scores").select("item_text").distinct().withColumn("prompt", X.prompt(F.col("item_text"), CLASSES))


_LISTS = ["medical_history", "allergies", "labs"]
_BLOCK = " || ".join(f"case when len({c}) > 0 then '[{c.upper()}]' || chr(10) || array_to_string(list_transform({c}, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) else '' end" for c in _LISTS)


@entry(f"select summary_id, regexp_replace({_BLOCK.replace('len(', 'len(').replace('case when len', 'case when len')}, '\\n\\n$', '') as context from (select summary_id, {', '.join(f'coalesce({c}, []) as {c}' for c in _LISTS)} from patient_summaries)")
def t14_context_blocks(spark, sf):
    return table(spark, sf, "patient_summaries").select("summary_id", X.context_block({c: F.col(c) for c in _LISTS}).alias("context"))


@entry("select entry_id, case when regexp_matches(k, '^[0-9]') then 'c_' || k else k end as slug from (select entry_id, regexp_replace(regexp_replace(lower(item), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as k from item_entries)")
def t11_slug_keys(spark, sf):
    return table(spark, sf, "item_entries").select("entry_id", X.slug_key(F.col("item")).alias("slug"))


@entry()
def t6_titles(spark, sf):
    return table(spark, sf, "item_mapping").select("canonical_id", X.titled("canonical_item").alias("title"))


@entry("select doc_id, " + " or ".join(f"contains(lower(text), '{t}')" for t in X.FORBIDDEN) + " as forbidden from documents")
def ref_p9_forbidden_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.holds_forbidden(F.col("text")).alias("forbidden"))


def _field(c: str) -> str:
    return f"lower({c})" if c == "summary" else f"lower(array_to_string({c}, ' '))"


_FIELDS = " union all ".join(f"select patient_id, {i} as i, '{c}' as field, {_field(c)} as t from patient_summaries" for i, c in enumerate(CONTEXT_FIELDS))
_NEEDLE = "needle as (select distinct s.patient_id, unnest(string_split(s.item_text, '; ')) as item_text from scores s)"


@entry(f"with {_NEEDLE}, f as ({_FIELDS}) select n.patient_id, n.item_text, arg_min(field, i) as field from (select distinct * from needle) n join f on f.patient_id = n.patient_id and contains(f.t, lower(n.item_text)) where n.item_text <> '' group by all")
def ref_p8_label_leakage(spark, sf):
    needle = table(spark, sf, "scores").select("patient_id", F.explode(F.split("item_text", "; ")).alias("item_text"))
    return V.label_leakage(needle, table(spark, sf, "patient_summaries"))


@entry("select vec_id, list_transform(embedding, lambda x: round(cast(x as double) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * cast(y as double)))), 1e-9), 6) + 0.0) as unit from embeddings")
def m3_l2_normalise(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(H.l2_normalised("embedding"), lambda x: F.round(x, 6) + 0.0).alias("unit"))


def _joined(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    first = e.groupBy("label").agg(F.min_by("vector", "vec_id").alias("vector")).where("label < 7")
    return H.context_vectors(e.select("vec_id", "label", F.col("vector").alias("item")), first, "label", 64)


@entry("""with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), c as (select label, arg_min(v, vec_id) as w from e where label < 7 group by label),
j as (select e.vec_id, v, coalesce(w, list_resize([]::double[], 64, 0.0)) as w from e left join c on c.label = e.label)
select vec_id, list_transform(list_concat(list_concat(list_concat(v, w), list_transform(list_zip(v, w), lambda z: z[1] * z[2])), list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))), lambda x: round(x, 6) + 0.0) as features from j""")
def m4_fusion_features(spark, sf):
    return _joined(spark, sf).select("vec_id", F.transform(H.fused("item", "context", "4_vector"), lambda x: F.round(x, 6) + 0.0).alias("features"))


@entry()
def m1_encode_texts(spark, sf):
    return H.encoded(table(spark, sf, "item_mapping"), "canonical_item", H.hashed_encoder(64), 64).select("canonical_item", F.size("vector").alias("n"))


@entry("select summary_id, unnest(['summary', 'labs', 'allergies']) as field, unnest([null, summary, summary]) as summary, unnest([len(labs), null, len(labs)]) as n_labs, unnest([len(allergies), len(allergies), null]) as n_allergies from patient_summaries")
def m5_field_ablation(spark, sf):
    done = H.ablated_contexts(table(spark, sf, "patient_summaries"), "summary_id", ["summary", "labs", "allergies"])
    return done.select("summary_id", "field", "summary", F.when(F.col("labs").isNotNull(), F.size("labs")).cast("bigint").alias("n_labs"), F.when(F.col("allergies").isNotNull(), F.size("allergies")).cast("bigint").alias("n_allergies"))


_SHOWN = {c: "summary" if c == "summary" else f"len({c})" for c in CONTEXT_FIELDS}


@entry(" union all ".join(f"select summary_id, '{f}' as field, " + ", ".join(("null" if c == f else v) + f" as {c}" for c, v in _SHOWN.items()) + " from patient_summaries" for f in CONTEXT_FIELDS))
def m5_field_ablation_all(spark, sf):
    done = H.ablated_contexts(table(spark, sf, "patient_summaries"), "summary_id", CONTEXT_FIELDS)
    return done.select("summary_id", "field", *("summary" if c == "summary" else F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint").alias(c) for c in CONTEXT_FIELDS))


@entry("select label, list_transform(range(64), lambda i: cast(0.0 as double)) as zero, count(*) as n from embeddings group by label")
def m2_pooling_groups(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("zero", F.array_repeat(F.lit(0.0), 64)).select("label", "zero", "n")


@entry("select label, list_transform(list(v order by d), lambda x: round(x, 6) + 0.0) as vector from (select label, d, avg(x) as v from (select label, unnest(embedding) as x, unnest(range(64)) as d from (select label, list_transform(embedding, lambda y: cast(y as double)) as embedding from embeddings)) group by label, d) group by label")
def m2_mean_pooling(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return H.pooled(e, "label", "vec_id", "vector").select("label", F.transform("vector", lambda x: F.round(x, 6) + 0.0).alias("vector"))


@entry()
def m7_whitened_pca(spark, sf):
    done, _ = H.whitened(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 8)
    return done.select("vec_id", "components")


def _labelled(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"), (F.col("label") < 5).cast("double").alias("y"))


@entry()
def ml_logistic(spark, sf):
    rows = _labelled(spark, sf)
    return H.predicted(rows, H.soft_logistic(rows, "vector", "y"), "vector").select("vec_id", "y", "p")


@entry()
def m9_fusion_or_passthrough(spark, sf):
    """A second-stage head kept only where its Brier score is better than the plain score's."""
    rows = cells(spark, sf).where("category = 'medications'").dropna(subset=["llm_context_free", "llm_correct_context", "physician_interview_consensus"])
    rows = rows.select("model", "patient", "item_text", F.array("llm_context_free", "llm_correct_context").alias("vector"), F.col("physician_interview_consensus").alias("y"), F.col("llm_context_free").alias("plain"))
    done = H.predicted(rows, H.soft_logistic(rows, "vector", "y"), "vector").persist()
    return done.withColumn("chosen", H.fusion_or_passthrough(done, "p", "plain", "y")).select("model", "patient", "item_text", "chosen")


@entry(sql("select patient, item_text, category, greatest(0.0, least(1.0, avg(llm_correct_context))) as p from cells where llm_correct_context is not null group by all", "cells"), "p")
def m10_ensemble_mean(spark, sf):
    rows = cells(spark, sf).where("llm_correct_context is not null").withColumn("p", F.col("llm_correct_context"))
    return H.ensemble_mean(rows, ["patient", "item_text", "category"])


@entry()
def v5_nested_folds(spark, sf):
    """Held-out predictions: a head is fitted without each fold and scores that fold."""
    rows = _labelled(spark, sf).withColumn("group", (F.col("vec_id") % 50).cast("string"))
    folds = cv.hash_folds(rows, "group", 3, 5)
    parts = cv.with_folds(rows, folds, "group").persist()
    out = None
    for k in range(3):
        model = H.soft_logistic(parts.where(F.col("fold") != k), "vector", "y")
        scored = H.predicted(parts.where(F.col("fold") == k), model, "vector").select("vec_id", "fold", "y", "p")
        out = scored if out is None else out.unionByName(scored)
    return out


@entry(sql("select 'llm_context_free' as field, category, avg(abs(llm_correct_context - llm_context_free)) as effect from cells where llm_correct_context is not null and llm_context_free is not null group by category", "cells"), "effect")
def e25_ablation_effect(spark, sf):
    rows = cells(spark, sf).dropna(subset=["llm_correct_context", "llm_context_free"])
    keys = ["model", "patient", "item_text"]
    base = rows.select(*keys, "category", F.col("llm_correct_context").alias("score"))
    less = rows.select(*keys, "category", F.lit("llm_context_free").alias("field"), F.col("llm_context_free").alias("score"))
    return G.ablation_effect(base, less, keys)
