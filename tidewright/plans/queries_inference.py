"""Intervals and tests around the statistics, raters, architectures and frame joins, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import inference as I
from tidewright.operators import metrics as M
from tidewright.plans.catalogue import entry
from tidewright.plans.queries_metrics import _CUM
from tidewright.plans.views import cells, consensus, preds, sheet, sql
from tidewright.sources.tables import CLASSES, study_ratings, table, unpivoted

_MC = ["model", "category"]
_HIT = "case when sign(delta_llm_correct) = sign(delta_physician) then 1.0 else 0.0 end"
_TAIL = "list_sum(list_transform(range(hits, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))))"
_SIGNS = f""", t as (select model, category, count(*) as n, cast(sum({_HIT}) as bigint) as hits, avg({_HIT}) as rate from cells where delta_physician <> 0 group by model, category),
p as (select *, least(1.0, {_TAIL}) as p from t), r as (select *, row_number() over (partition by model order by p) as k, count(*) over (partition by model) as m from p)"""


@entry(sql(f"{_SIGNS} select model, category, n, hits, rate, p, least(1.0, min(p * m / k) over (partition by model order by p desc, k desc rows unbounded preceding)) as p_adjusted from r", "cells"), "rate p p_adjusted")
def e9_sign_tests(spark, sf):
    return I.sign_tests(cells(spark, sf), _MC, ["model"])


@entry(sql(f"{_SIGNS} select model, category, p, least(1.0, min(p * m / k) over (partition by model order by p desc, k desc rows unbounded preceding)) as p_adjusted from r", "cells"), "p p_adjusted")
def e12_bh(spark, sf):
    from tidewright.operators.agreement import benjamini_hochberg, sign_agreement

    tested = sign_agreement(cells(spark, sf), _MC).withColumn("p", I.binomial_p("hits", "n"))
    return benjamini_hochberg(tested, "p", partition=["model"]).select("model", "category", "p", "p_adjusted")


@entry()
def e9_sign_intervals(spark, sf):
    return I.sign_tests_resampled(cells(spark, sf), _MC, ["model"])


@entry()
def e10_cmh_test(spark, sf):
    return I.cmh_test(cells(spark, sf), "category", ["model"])


@entry()
def e13_brier_tests(spark, sf):
    return I.brier_tests(cells(spark, sf), _MC, ["model"])


@entry()
def e14_wasserstein_intervals(spark, sf):
    return I.wasserstein_interval(cells(spark, sf), _MC, "llm_correct_context", "physician_interview_consensus", "patient")


@entry()
def e15_macro_tests(spark, sf):
    whole = cells(spark, sf)
    return I.macro_improvement(whole, I.brier_tests(whole, _MC, ["model"]))


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    from tidewright.operators.fuzzy import strata

    return strata(cells(spark, sf), "item_text", sheet(spark, sf, "train").select("item"))


@entry()
def e23_stratum_tests(spark, sf):
    return I.stratum_tests(_strata(spark, sf), ["model"])


@entry()
def e23_mann_whitney(spark, sf):
    gain = "round(power(llm_context_free - physician_interview_consensus, 2) - power(llm_correct_context - physician_interview_consensus, 2), 9)"
    return I.mann_whitney(_strata(spark, sf).withColumn("d", F.expr(gain)), ["model"], "d", F.col("stratum") == "novel")


_ARCH = """, s as (select model, category, avg((p - y) * (p - y)) as b, 2 * sum(case when p >= 0.5 then y else 0.0 end) as tp2, sum(case when p >= 0.5 then 1 - y else 0.0 end) as fp, sum(case when p >= 0.5 then 0.0 else y end) as fn from preds group by model, category),
m as (select model, avg(b) as brier, avg(coalesce(tp2 / nullif(tp2 + fp + fn, 0), 0.0)) as f1 from s group by model), z as (select * from m where model = (select min(model) from m))
select m.model, m.brier, m.f1, m.brier - z.brier as brier_delta, m.f1 - z.f1 as f1_delta from m, z"""


def _reference_model(rows: DataFrame) -> str:
    return rows.agg(F.min("model")).first()[0]


@entry(sql(_ARCH, "preds"), "brier f1 brier_delta f1_delta")
def e24_arch_comparison(spark, sf):
    rows = preds(spark, sf)
    return I.architectures(rows, _reference_model(rows))


@entry()
def e24_arch_intervals(spark, sf):
    rows = preds(spark, sf)
    return I.architecture_intervals(rows, _reference_model(rows))


@entry()
def x9_ece_intervals(spark, sf):
    return I.calibration_interval(preds(spark, sf), _MC, "patient")


_LABELS = ", lab as (" + " union all ".join(f"select sheet, patient, item, physician, '{c}' as category, cast({c} as int) as label from last_ where {c} is not null" for c in CLASSES) + ")"
_LAST = """, last_ as (select * from (select *, row_number() over (partition by sheet, patient, item, physician order by row_id desc) as o_ from rv where patient is not null and item is not null and physician is not null) where o_ = 1)"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return I.individual_labels(study_ratings(spark, sf), ["sheet", "patient", "item"], "physician", CLASSES, "row_id")


@entry(sql(f"{_LAST}{_LABELS} select * from lab", "rv"))
def e21_individual_labels(spark, sf):
    return _labels(spark, sf)


def _rater_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = preds(spark, sf)
    one = rows.where(F.col("model") == _reference_model(rows)).select("patient", F.col("item_text").alias("item"), "category", "p")
    return one, _labels(spark, sf).where("sheet = 'interview'").drop("sheet")


_ICC = """, b as ({both}), big as (select {keys}, count(distinct item) as n_items from b group by all having count(distinct item) >= 2),
f as (select b.* from b join big using ({keys})), g as (select {keys}, (avg(x) + avg(y)) / 2 as g, avg(x) as mx, avg(y) as my, count(*) as n from f group by all),
s as (select {keys}, n, 2 * sum(((x + y) / 2 - g) * ((x + y) / 2 - g)) / nullif(n - 1, 0) as ms_t, n * ((mx - g) * (mx - g) + (my - g) * (my - g)) as ms_r,
  sum(pow(x - (x + y) / 2 - mx + g, 2) + pow(y - (x + y) / 2 - my + g, 2)) / nullif(n - 1, 0) as ms_e from f join g using ({keys}) group by {keys}, n, mx, my, g),
i as (select {keys}, case when n > 1 and abs(ms_t + ms_e + 2 * (ms_r - ms_e) / n) >= 1e-12 then (ms_t - ms_e) / (ms_t + ms_e + 2 * (ms_r - ms_e) / n) end as icc from s),
c as (select {keys}, case when var_pop(x) + var_pop(y) + pow(avg(x) - avg(y), 2) > 1e-12 then 2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + pow(avg(x) - avg(y), 2)) end as ccc from f group by all)
select {keys}, n_items, icc, ccc from big join i using ({keys}) join c using ({keys})"""


@entry(sql(_LAST + _LABELS + _ICC.format(keys="patient, physician", both="select l.patient, l.physician, l.item, l.category, p.p as x, cast(l.label as double) as y from lab l join preds p on p.patient = l.patient and p.item_text = l.item and p.category = l.category where l.sheet = 'interview' and p.model = (select min(model) from preds) and p.p is not null"), "preds", "rv"), "icc ccc")
def e20_rater_icc(spark, sf):
    return I.rater_agreement(*_rater_frames(spark, sf))


@entry(sql(_LAST + _LABELS + ", k as (select *, row_number() over (partition by patient order by physician) as k from (select distinct patient, physician from lab where sheet = 'interview'))" + _ICC.format(keys="patient", both="select l.patient, l.item, l.category, cast(l.label as double) as x, cast(m.label as double) as y from lab l join k a on a.patient = l.patient and a.physician = l.physician and a.k = 1 join lab m on m.patient = l.patient and m.item = l.item and m.category = l.category and m.sheet = 'interview' join k b on b.patient = m.patient and b.physician = m.physician and b.k = 2 where l.sheet = 'interview'"), "rv"), "icc ccc")
def e20_human_icc(spark, sf):
    return I.human_agreement(_rater_frames(spark, sf)[1])


@entry()
def e20_rater_summary(spark, sf):
    one, labels = _rater_frames(spark, sf)
    return I.rater_summary(I.rater_agreement(one, labels), "model").unionByName(I.rater_summary(I.human_agreement(labels), "human"))


@entry(sql(" union all ".join(f"select '{c}' as category, least(greatest(0.001 / (1 - pow(0.999, greatest(sum({c}), 1))), 1.0), 50.0) as weight from cons where sheet = 'train'" for c in CLASSES), "cons"), "weight")
def a26_effective_weights(spark, sf):
    from tidewright.operators.features import class_weight

    long = unpivoted(consensus(spark, sf, "train"), ["patient", "item"], CLASSES)
    return long.groupBy("category").agg(F.sum("score").alias("m"), F.count(F.lit(1)).alias("n")).select("category", class_weight(F.coalesce("m", F.lit(0.0)), F.col("n")).alias("weight"))


_HARD = _CUM.replace("preds", "hard") if "preds" in _CUM else _CUM


@entry(sql(f", hard as (select model, category, case when y > 0.5 then 1.0 else 0.0 end as y, p from preds){_HARD}, per as (select category, case when max(all_pos) > 0 and max(all_neg) > 0 then sum(pos * (all_neg - fp + neg / 2)) / (max(all_pos) * max(all_neg)) else 0.5 end as auc from cum group by category) select count(*) as n_groups, avg(auc) as macro_auc from per", "preds"), "macro_auc")
def c15_hard_macro_auc(spark, sf):
    hard = preds(spark, sf).withColumn("y", (F.col("y") > 0.5).cast("double"))
    return M.macro(M.roc_auc(hard, ["category"]), "category", ["auc"])


_SHEETS = "select patient, item, count(*) as n from rv where sheet = '{}' group by all"


@entry(sql(f", a as ({_SHEETS.format('test')}), b as ({_SHEETS.format('interview')}), j as (select coalesce(a.n, 0) as l, coalesce(b.n, 0) as r from a full join b on a.patient is not distinct from b.patient and a.item is not distinct from b.item) select cast(sum(least(l, r)) as bigint) as n_both, cast(sum(greatest(l - r, 0)) as bigint) as n_left_only, cast(sum(greatest(r - l, 0)) as bigint) as n_right_only from j", "rv"))
def j5_alignment(spark, sf):
    return I.alignment(sheet(spark, sf, "test"), sheet(spark, sf, "interview"), ["patient", "item"])


@entry("select e.entry_id, coalesce(f.v, p.v) as found from item_entries e left join (select lower(trim(canonical_item)) as k, min(canonical_id) as v from item_mapping where canonical_item is not null group by 1) f on lower(trim(e.item)) = f.k left join (select canonical_item as k, min(canonical_id) as v from item_mapping group by 1) p on e.item = p.k")
def j12_lookup_with_fallback(spark, sf):
    return I.looked_up(table(spark, sf, "item_entries").select("entry_id", "item"), table(spark, sf, "item_mapping"), "item", "canonical_item", "canonical_id", "found").select("entry_id", "found")


@entry(sql(f", g as (select m.model, c.category from (select distinct model from cells) m, (select unnest({CLASSES!r}) as category) c), t as (select model, category, count(*) as n, avg({_HIT}) as rate from cells where delta_physician <> 0 and delta_physician > 0.9 group by all) select g.model, g.category, coalesce(n, 0) as n, rate from g left join t on t.model = g.model and t.category = g.category", "cells"), "rate")
def x7_empty_slices(spark, sf):
    """The strongest upward shifts, with a row for classes that have none."""
    whole = cells(spark, sf)
    strong = whole.where("delta_physician <> 0 and delta_physician > 0.9").groupBy(*_MC).agg(F.count(F.lit(1)).alias("n"), F.avg(I.sign_hit()).alias("rate"))
    every = whole.select("model").distinct().withColumn("category", F.explode(F.array(*map(F.lit, CLASSES))))
    return I.with_empty_rows(strong, every, ["n"])
