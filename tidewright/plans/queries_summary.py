"""Stage by stage summaries of the rating and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import cells as C
from tidewright.operators import fuzzy as Z
from tidewright.operators import summary as S
from tidewright.plans.catalogue import entry
from tidewright.plans.views import reference, sheet, sql
from tidewright.sources.tables import CLASSES, study_ratings, table

_CL = ", ".join(CLASSES)
_BIN = {c: f"(case when coalesce({c}, 0) > 0 then 1 else 0 end)" for c in CLASSES}
_N = " + ".join(_BIN.values())
_STEPS = {"n_positive": "delta > 0", "n_negative": "delta < 0", "n_zero": "delta = 0", "n_minus_one": "delta = -1", "n_plus_one": "delta = 1", "n_minus_half": "delta = -0.5", "n_plus_half": "delta = 0.5"}


def _steps(groups: str, source: str) -> str:
    counts = ", ".join(f"count_if({e}) as {n}" for n, e in _STEPS.items())
    pct = ", ".join(f"case when n_valid > 0 then 100.0 * {n} / n_valid else 0.0 end as {n.replace('n_', 'pct_', 1)}" for n in _STEPS)
    return f"select *, {pct} from (select {groups}, count(delta) as n_valid, {counts} from ({source} union all select * replace ('Total' as category) from ({source})) group by all)"


_PCT = " ".join(n.replace("n_", "pct_", 1) for n in _STEPS)


@entry(sql(_steps("category", "select * from ref"), "ref"), _PCT)
def a4_delta_distribution(spark, sf):
    return S.delta_distribution(reference(spark, sf))


_STRATA = "select ref.*, case when k.item is null then 'novel' else 'repeated' end as stratum from ref left join (select distinct lower(item) as item from rv where sheet = 'train' and item is not null) k on lower(ref.item_text) = k.item"


@entry(sql(_steps("stratum, category", _STRATA), "ref"), _PCT)
def a4_delta_by_stratum(spark, sf):
    marked = Z.strata(reference(spark, sf), "item_text", sheet(spark, sf, "train"))
    return S.delta_distribution(marked, ["stratum"])


@entry(sql("select sheet, count(*) as n_rows, count(distinct item) as n_items, count(distinct patient) as n_patients, count_if(item is null) as n_missing_items from rv group by sheet", "rv"))
def a5_stage_stats(spark, sf):
    return S.stage_stats(study_ratings(spark, sf))


_COLS = ["patient", "physician", "item", *CLASSES]


@entry(sql(" union all ".join(f"select sheet, '{c}' as column_name, count_if({c} is null) as n_missing, 100.0 * count_if({c} is null) / count(*) as pct_missing from rv group by sheet" for c in _COLS), "rv"), "pct_missing")
def a6_missingness(spark, sf):
    return S.missingness(study_ratings(spark, sf), _COLS)


@entry(sql("select patient, count(*) as n_rows, 100.0 * count(*) / (select count(*) from rv) as pct from rv group by patient", "rv"), "pct")
def a7_entity_distribution(spark, sf):
    return S.entity_distribution(study_ratings(spark, sf))


@entry(" union all ".join(f"select '{c}' as category, sum({_BIN[c]}) as n_positive, 100.0 * sum({_BIN[c]}) / count(*) as pct from ratings" for c in CLASSES), "n_positive pct")
def a8_class_distribution(spark, sf):
    return S.class_distribution(table(spark, sf, "ratings"), CLASSES).withColumn("n_positive", F.col("n_positive").cast("double"))


@entry(" union all ".join(f"select '{a}' as class_a, '{b}' as class_b, cast(sum({_BIN[a]} * {_BIN[b]}) as bigint) as n_both from ratings" for a in CLASSES for b in CLASSES))
def a9_cooccurrence(spark, sf):
    return S.cooccurrence(table(spark, sf, "ratings"), CLASSES)


_LEN = "n_ as (select len(regexp_extract_all(text, '\\S+')) as n from documents where text is not null)"


@entry(f"with {_LEN} select count(n) as n_texts, median(n) as median_words, min(n) as min_words, max(n) as max_words, avg(n) as mean_words, stddev_pop(n) as std_words from n_", "median_words mean_words std_words min_words max_words")
def a10_text_length(spark, sf):
    return S.text_length(table(spark, sf, "documents")).withColumns({c: F.col(c).cast("double") for c in ("min_words", "max_words")})


@entry(f"with {_LEN}, e as (select min(n) as lo, max(n) as hi from n_) select cast(case when hi = lo then 0 else greatest(0, ceil((n - lo) / ((hi - lo) / 20.0) - 1e-9) - 1) end as int) as bin, count(*) as n_texts from n_, e group by 1")
def a10_text_length_bins(spark, sf):
    return S.text_length_bins(table(spark, sf, "documents"))


@entry(sql(f"select patient, count(*) as n_rows, {', '.join(f'sum({c}) as sum_{c}' for c in CLASSES)}, cast(sum({_N}) as bigint) as n_labels from rv group by patient", "rv"), " ".join(f"sum_{c}" for c in CLASSES))
def a11_a13_entity_burden(spark, sf):
    return S.entity_class_counts(study_ratings(spark, sf), CLASSES)


@entry(f"with n_ as (select {_N} as n from ratings) select count(*) as n_rows, avg(n) as mean_labels, 100.0 * avg(cast(n = 0 as int)) as pct_0, 100.0 * avg(cast(n = 1 as int)) as pct_1, 100.0 * avg(cast(n = 2 as int)) as pct_2, 100.0 * avg(cast(n > 2 as int)) as pct_3_or_more from n_", "mean_labels pct_0 pct_1 pct_2 pct_3_or_more")
def a12_cardinality(spark, sf):
    return S.label_cardinality(table(spark, sf, "ratings"), CLASSES)


@entry(f"select {_N} as n_labels, count(*) as n_rows from ratings group by 1")
def a12_cardinality_distribution(spark, sf):
    return S.label_cardinality_distribution(table(spark, sf, "ratings"), CLASSES)


_LONG = " union all ".join(f"select patient, '{c}' as category, {c} as score from rv" for c in CLASSES)


@entry(sql(f", per as (select category, patient, sum(case when coalesce(score, 0) > 0 then 1 else 0 end) as p, count(*) as n from ({_LONG}) where patient is not null group by category, patient) select category, cast(sum(p) as bigint) as n_positive, sum(p) / sum(n) as prevalence, {', '.join(f'count_if(p = {k}) as entities_with_{k}' for k in range(5))}, count_if(p < 5) as entities_below_5 from per group by category", "rv"), "prevalence")
def a14_buckets(spark, sf):
    return S.positive_buckets(study_ratings(spark, sf), CLASSES)


_CONS = "(" + " union all ".join(f"select '{c}' as category, {c} as score from cons where sheet = 'test'" for c in CLASSES) + ")"


@entry(sql(f"select *, case when n_fractional > 0 then 'fractional' else 'binary' end as label_type from (select category, count_if(score = 0) as n_zero, count_if(score = 1) as n_one, count_if(score <> 0 and score <> 1) as n_fractional from {_CONS} where score is not null group by category)", "cons"))
def a15_fractional_audit(spark, sf):
    from tidewright.plans.views import consensus

    return S.fractional_audit(consensus(spark, sf, "test"), CLASSES)


@entry(sql(f"select category, value, n, 100.0 * n / sum(n) over (partition by category) as pct, dense_rank() over (order by n desc) as rank from (select category, score as value, count(*) as n from {_CONS} where score is not null group by all)", "cons"), "value pct rank")
def a16_fractional_values(spark, sf):
    from tidewright.plans.views import consensus

    return S.fractional_values(consensus(spark, sf, "test"), CLASSES).withColumn("rank", F.col("rank").cast("double"))


_EXACT = ["sheet", "patient", "physician", "item", *CLASSES, "rated_at"]


def _repeat(keys: str, name: str, value: str) -> str:
    return f"select '{name}' as measure, cast(coalesce({value}, 0) as bigint) as value from (select count(*) as n from rv group by {keys})"


@entry(sql(" union all ".join([_repeat(", ".join(_EXACT), "exact_excess", "sum(n - 1)"), _repeat("patient, item", "patient_item_groups", "count_if(n > 1)"), _repeat("patient, physician, item", "triplet_excess", "sum(n - 1)"), _repeat("item", "item_groups", "count_if(n > 1)")]), "rv"))
def a17_duplicate_profile(spark, sf):
    return S.duplicate_profile(study_ratings(spark, sf), _EXACT)


@entry(sql("select item, count(*) as n, 100.0 * count(*) / (select count(*) from rv) as pct from rv where item is not null group by item", "rv"), "pct")
def a18_item_frequency(spark, sf):
    return S.item_frequency(table(spark, sf, "ratings"))


_FORMS = """forms as (select form, min(canonical) as canonical from (select lower(regexp_replace(unnest(list_concat([canonical_item], coalesce(variants, []))), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as form, canonical_item as canonical from item_mapping) where form <> '' group by form)"""
_STD = """std as (select e.*, f.canonical is not null as resolved, coalesce(f.canonical, regexp_replace(e.item, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) as standard from item_entries e left join forms f on f.form = lower(regexp_replace(e.item, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')))"""


@entry(f"with {_FORMS}, {_STD}, p as (select sheet, item as r, standard as s, count(*) as n from std where item is not null group by all), f as (select sheet, s, count(distinct r) as raw_forms, sum(case when r <> s then n else 0 end) as changed from p group by sheet, s) select f.sheet, count(s) as n_standard, cast(sum(changed) as bigint) as n_changed, count_if(raw_forms > 1) as n_collapsed, any_value(n_raw) as n_raw from f join (select sheet, count(distinct r) as n_raw from p group by sheet) q on q.sheet = f.sheet group by f.sheet")
def a19_standardisation(spark, sf):
    done = Z.exact_mapping(table(spark, sf, "item_entries"), "item", table(spark, sf, "item_mapping"))
    return S.standardisation_impact(done, "item", "standard")


_MARKS = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
_PAIRS = [("train", "test"), ("train", "interview"), ("test", "interview")]


@entry(sql(f""", b as (select distinct sheet, regexp_replace(item, '^{_MARKS}+|{_MARKS}+$', '', 'g') as i from rv where item is not null), s as (select i, list(sheet) as l from b where i <> '' group by i)
""" + " union all ".join(f"select *, case when n_union > 0 then n_common / n_union else 0.0 end as jaccard from (select '{a}' as split_a, '{b}' as split_b, count_if(list_contains(l, '{a}') and list_contains(l, '{b}')) as n_common, count_if(list_contains(l, '{a}') or list_contains(l, '{b}')) as n_union, count_if(list_contains(l, '{a}') and not list_contains(l, '{b}')) as n_only_a, count_if(list_contains(l, '{b}') and not list_contains(l, '{a}')) as n_only_b from s)" for a, b in _PAIRS), "rv"), "jaccard")
def a20_split_overlap(spark, sf):
    return S.split_overlap(study_ratings(spark, sf), _PAIRS)


_G = f"(select sheet, patient, item, count(*) as n, {', '.join(f'case when count(distinct {c}) > 1 then 1 else 0 end as {c}' for c in CLASSES)} from rv group by sheet, patient, item having count(*) > 1)"


@entry(sql(" union all ".join(f"select '{c}' as category, count(*) as n_groups, cast(coalesce(sum({c}), 0) as bigint) as n_conflicting, coalesce(sum({c}), 0) / greatest(count(*), 1) as rate from {_G}" for c in CLASSES), "rv"), "rate")
def a21_disagreement(spark, sf):
    return S.disagreement(study_ratings(spark, sf), ["sheet", "patient", "item"], CLASSES)


@entry(sql(f"select sheet, patient, item, n as n_rows, {' + '.join(CLASSES)} as n_conflicts from {_G} where {' + '.join(CLASSES)} > 0", "rv"))
def a21_conflicting_groups(spark, sf):
    return S.conflicting_groups(study_ratings(spark, sf), ["sheet", "patient", "item"], CLASSES)


_AGREE = f""", o as (select *, dense_rank() over (partition by sheet, patient order by physician) as obs from rv where patient is not null and physician is not null and item is not null),
one as (select * from (select *, row_number() over (partition by sheet, patient, item, physician order by row_id desc) as rn from o where obs <= 2) where rn = 1),
l as ({" union all ".join(f"select a.sheet, a.patient, a.{c} as x, b.{c} as y from one a join one b on a.sheet = b.sheet and a.patient = b.patient and a.item = b.item and a.obs = 1 and b.obs = 2" for c in CLASSES)})
select sheet, patient, count(*) as n_labels, avg(cast(x = y as int)) as agreement from l where x is not null and y is not null group by sheet, patient"""


@entry(sql(_AGREE, "rv"), "agreement")
def a22_observer_agreement(spark, sf):
    return S.observer_agreement(study_ratings(spark, sf), CLASSES, "row_id")


@entry("select doc_kind, lang, count(*) as n from documents group by all")
def u_document_kinds(spark, sf):
    return table(spark, sf, "documents").groupBy("doc_kind", "lang").agg(F.count(F.lit(1)).alias("n"))


@entry("select item, count(*) as n from ratings where item is not null group by item order by n desc, item limit 20")
def o3_top_items(spark, sf):
    return table(spark, sf, "ratings").where("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(20)


@entry("select 'scores' as source, patient_id as patient, count(*) as n from scores group by all union all select 'summaries', patient_id, count(*) from patient_summaries group by all")
def u1_union_of_sources(spark, sf):
    a, b = table(spark, sf, "scores"), table(spark, sf, "patient_summaries")
    part = lambda df, name: df.groupBy(F.col("patient_id").alias("patient")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(name))
    return part(a, "scores").unionByName(part(b, "summaries"))


@entry("select distinct patient_id from scores intersect select distinct patient_id from patient_summaries")
def u2_common_patients(spark, sf):
    return table(spark, sf, "scores").select("patient_id").intersect(table(spark, sf, "patient_summaries").select("patient_id"))
