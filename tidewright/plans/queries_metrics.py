"""Classification metrics, calibration, thresholds and agreement statistics over the paired cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import agreement as G
from tidewright.operators import metrics as M
from tidewright.operators import resample as S
from tidewright.plans.catalogue import entry
from tidewright.plans.views import cells, consensus, preds, sheet, sql
from tidewright.sources.tables import CLASSES, study_ratings, unpivoted

_G = ["category"]
_CM = "select category, sum(case when p >= {t} then y else 0.0 end) as tp, sum(case when p >= {t} then 1 - y else 0.0 end) as fp, sum(case when p >= {t} then 0.0 else y end) as fn, sum(case when p >= {t} then 0.0 else 1 - y end) as tn from preds group by category"


def _r(a: str, b: str) -> str:
    return f"(case when {b} > 0 then ({a}) / ({b}) else 0.0 end)"


_P, _R = _r("tp", "tp + fp"), _r("tp", "tp + fn")


def _prf(source: str) -> str:
    return f"""select *, {_r('2 * precision * recall', 'precision + recall')} as f1, {_r('1.25 * precision * recall', '0.25 * precision + recall')} as f_beta,
  (tp * tn - fp * fn) / sqrt(greatest((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn), 1e-8)) as mcc, recall + {_r('tn', 'tn + fp')} - 1 as youden from (select *, {_P} as precision, {_R} as recall from ({source}))"""


@entry(sql(_CM.format(t=0.5), "preds"), "tp fp fn tn")
def c1_confusion(spark, sf):
    return M.confusion(preds(spark, sf), _G)


@entry(sql(_prf(_CM.format(t=0.5)), "preds"), "tp fp fn tn precision recall f1 f_beta mcc youden")
def c2_prf_mcc(spark, sf):
    return M.precision_recall(M.confusion(preds(spark, sf), _G))


_CUM = """, at_ as (select category, p, sum(y) as pos, sum(1 - y) as neg from preds group by category, p),
cum as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by category) as all_pos, sum(neg) over (partition by category) as all_neg from at_ window w as (partition by category order by p desc rows unbounded preceding))"""
_PR = f", pr as (select category, p, {_r('tp', 'tp + fp')} as precision, {_r('tp', 'all_pos')} as recall from cum)"


@entry(sql(_CUM + _PR + " select * from pr", "preds"), "precision recall")
def c3_pr_curve(spark, sf):
    return M.pr_curve(preds(spark, sf), _G)


@entry(sql(_CUM + _PR + ", st as (select *, lag(recall, 1, 0.0) over (partition by category order by p desc) as r0, lag(precision, 1, 1.0) over (partition by category order by p desc) as q0 from pr) select category, sum((recall - r0) * precision) as ap, sum((recall - r0) * (precision + q0) / 2) as auc_pr from st group by category", "preds"), "ap auc_pr")
def c3_pr_ap(spark, sf):
    return M.average_precision(preds(spark, sf), _G)


@entry(sql(_CUM + " select category, case when max(all_pos) > 0 and max(all_neg) > 0 then sum(pos * (all_neg - fp + neg / 2)) / (max(all_pos) * max(all_neg)) else 0.5 end as auc from cum group by category", "preds"), "auc")
def c5_roc_auc(spark, sf):
    return M.roc_auc(preds(spark, sf), _G)


@entry(sql(_CUM + f" select category, p, {_r('fp', 'all_neg')} as fpr, {_r('tp', 'all_pos')} as tpr from cum", "preds"), "fpr tpr")
def c6_roc_curve(spark, sf):
    return M.roc_curve(preds(spark, sf), _G)


_BINS = ", bins as (select category, cast(least(floor(p * 15), 14) as int) as bin, count(*) as n, avg(p) as mean_p, avg(y) as mean_y from preds where p between 0 and 1 group by 1, 2)"
_ECE = "select category, sum(n * abs(mean_p - mean_y)) / sum(n) as ece from bins group by category"


@entry(sql(_BINS + " select * from bins", "preds"), "mean_p mean_y")
def c8_calibration_bins(spark, sf):
    return M.calibration_bins(preds(spark, sf), _G)


@entry(sql(_BINS + f" select e.category, case when not (f.lo = f.hi and f.n > 1) then ece end as ece from ({_ECE}) e join (select category, min(p) as lo, max(p) as hi, count(*) as n from preds group by category) f on e.category = f.category", "preds"), "ece")
def c8_ece(spark, sf):
    return M.expected_calibration_error(preds(spark, sf), _G)


@entry(sql(_BINS + f" select *, ece > 0.1 as flagged from ({_ECE})", "preds"), "ece")
def c9_calibration_flags(spark, sf):
    return M.expected_calibration_error(preds(spark, sf), _G, constant_is_null=False).withColumn("flagged", F.col("ece") > 0.1)


_BRIER = "select category, avg((p - y) * (p - y)) as brier from preds group by category"


@entry(sql(_BRIER, "preds"), "brier")
def c10_brier(spark, sf):
    return M.brier(preds(spark, sf), _G)


@entry(sql(f"select count(*) as n_groups, avg(brier) as macro_brier from ({_BRIER})", "preds"), "macro_brier")
def c10_macro_brier(spark, sf):
    return M.macro(M.brier(preds(spark, sf), _G), "category", ["brier"])


_C11 = f""", c as ({_CM.format(t=0.5)}), a as (select * from c union all select 'Micro Aggregate', sum(tp), sum(fp), sum(fn), sum(tn) from c),
m as (select category, precision, recall, f1, mcc, (tp + fn) / (tp + fp + fn + tn) as prevalence, (tp + fp) / (tp + fp + fn + tn) as predicted_rate from ({_prf('select * from a')}))
select category, round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1, round(mcc, 4) as mcc, round(prevalence, 4) as prevalence, round(predicted_rate, 4) as predicted_rate
from (select * from m union all select 'Macro Average', avg(precision), avg(recall), avg(f1), avg(mcc), avg(prevalence), avg(predicted_rate) from m where category <> 'Micro Aggregate')"""


@entry(sql(_C11, "preds"), "precision recall f1 mcc prevalence predicted_rate")
def c11_metrics_table(spark, sf):
    return M.metrics_table(preds(spark, sf), "category")


_GRID = M.threshold_grid(0.05, 0.95, 19)
_TUNE = f""", grid as (select unnest([{', '.join(map(str, _GRID))}]) as threshold), q as (select category, threshold, sum(case when p >= threshold then y else 0.0 end) as tp, sum(case when p >= threshold then 1 - y else 0.0 end) as fp,
  sum(case when p >= threshold then 0.0 else y end) as fn, sum(case when p >= threshold then 0.0 else 1 - y end) as tn from preds cross join grid group by category, threshold),
t as ({_prf('select * from q')}), k as (select *, row_number() over (partition by category order by (recall >= {{floor}}) desc, round(f1, 12) desc, threshold) as rn from t)"""


@entry(sql(_TUNE.format(floor=0.0) + " select category, threshold, f1 as score from k where rn = 1", "preds"), "threshold score")
def c12_threshold_tuning(spark, sf):
    return M.tuned_thresholds(preds(spark, sf), _G, _GRID)


@entry(sql(_TUNE.format(floor=0.6) + " select category, threshold, f1 as score from k where rn = 1", "preds"), "threshold score")
def c12_threshold_tuning_floor(spark, sf):
    return M.tuned_thresholds(preds(spark, sf), _G, _GRID, recall_floor=0.6)


@entry(sql(_TUNE.format(floor=0.0) + " select category, threshold, f1 as score, abs(threshold - 0.5) as gap, abs(threshold - 0.5) <= 0.05 + 1e-12 as robust from k where rn = 1", "preds"), "threshold score gap")
def e22_tau(spark, sf):
    return G.tau_check(M.tuned_thresholds(preds(spark, sf), _G, _GRID), 0.5)


@entry()
def ml_isotonic(spark, sf):
    rows = preds(spark, sf).persist()
    parts = [M.isotonic(rows.where(F.col("category") == c)).select("model", "category", "patient", "item_text", "p", "calibrated") for c in CLASSES]
    return reduce(DataFrame.unionByName, parts)


_SIGN = "(case when sign(delta_llm_correct) = sign(delta_physician) then 1 else 0 end)"


@entry(sql(f"select model, category, count(*) as n, cast(sum({_SIGN}) as bigint) as hits, avg({_SIGN}) as rate from cells where delta_physician <> 0 group by model, category", "cells"), "rate")
def e9_sign_agreement(spark, sf):
    return G.sign_agreement(cells(spark, sf), ["model", "category"])


@entry()
def e9_binomial_bh(spark, sf):
    """Exact binomial tail per class, adjusted step-up; one row per model and class reaches the driver."""
    rows = G.sign_agreement(cells(spark, sf), ["model", "category"]).select("model", "category", "n", "hits").collect()
    table = spark.createDataFrame([(m, c, n, h, G.binomial_tail(h, n)) for m, c, n, h in rows], "model string, category string, n bigint, hits bigint, p double")
    return G.benjamini_hochberg(table, "p", partition=["model"])


_CMH = """, t as (select model, category, count_if(delta_physician > 0 and coalesce(delta_llm_correct > 0, false)) as a, count_if(delta_physician > 0 and not coalesce(delta_llm_correct > 0, false)) as b,
  count_if(delta_physician < 0 and coalesce(delta_llm_correct > 0, false)) as c, count_if(delta_physician < 0 and not coalesce(delta_llm_correct > 0, false)) as d from cells where delta_physician <> 0 group by model, category),
tt as (select *, cast(a + b + c + d as double) as n from t where a + b > 0 and c + d > 0 and a + c > 0 and b + d > 0),
s as (select model, count(*) as n_strata, sum(a * d / n) as num, sum(b * c / n) as den, sum(a - (a + b) * (a + c) / n) as dev, sum(cast(a + b as double) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) as var from tt group by model)
select model, n_strata, case when den > 0 then num / den end as odds_ratio, case when var > 0 then dev * dev / var end as chi2 from s"""


@entry(sql(_CMH, "cells"), "odds_ratio chi2")
def e10_cmh(spark, sf):
    return G.mantel_haenszel(cells(spark, sf), "category", ["model"])


_BI = "llm_context_free is not null and llm_correct_context is not null and physician_interview_consensus is not null"
_GAP = "({0} - physician_interview_consensus) * ({0} - physician_interview_consensus)"
_IMP = f"{_GAP.format('llm_context_free')} - {_GAP.format('llm_correct_context')}"


@entry(sql(f"select model, category, count(*) as n, avg({_GAP.format('llm_context_free')}) as brier_free, avg({_GAP.format('llm_correct_context')}) as brier_context, avg({_IMP}) as improvement from cells where {_BI} group by model, category", "cells"), "brier_free brier_context improvement")
def e13_brier_improvement(spark, sf):
    return G.brier_improvement(cells(spark, sf), ["model", "category"])


_DIFF = f"round({_IMP}, 9)"


@entry(sql(f", v as (select model, category, {_DIFF} as d from cells where {_BI}), z as (select *, abs(d) as a from v where d <> 0), k as (select *, rank() over (partition by model, category order by a) + (count(*) over (partition by model, category, a) - 1) / 2.0 as r from z) select model, category, count(*) as n, sum(case when d > 0 then r else 0.0 end) as w_plus from k group by model, category", "cells"), "w_plus")
def e13_signed_rank(spark, sf):
    rows = cells(spark, sf).where(_BI).withColumn("d", F.round(F.expr(_IMP), 9))
    return G.signed_rank(rows, ["model", "category"], "d")


@entry(sql(f"select count(*) as n_groups, avg(improvement) as macro_improvement, avg(brier_context) as macro_brier_context, model from (select model, category, avg({_GAP.format('llm_correct_context')}) as brier_context, avg({_IMP}) as improvement from cells where {_BI} group by model, category) group by model", "cells"), "macro_improvement macro_brier_context")
def e15_macro_summary(spark, sf):
    return M.macro(G.brier_improvement(cells(spark, sf), ["model", "category"]), "category", ["improvement", "brier_context"], ["model"])


_W = "llm_correct_context is not null and physician_interview_consensus is not null"


@entry(sql(f", a as (select model, category, llm_correct_context as l, row_number() over (partition by model, category order by llm_correct_context) as k from cells where {_W}), b as (select model, category, physician_interview_consensus as r, row_number() over (partition by model, category order by physician_interview_consensus) as k from cells where {_W}) select a.model, a.category, avg(abs(l - r)) as w1 from a join b on a.model = b.model and a.category = b.category and a.k = b.k group by a.model, a.category", "cells"), "w1")
def e14_wasserstein(spark, sf):
    return G.wasserstein(cells(spark, sf), ["model", "category"], "llm_correct_context", "physician_interview_consensus")


_BITS = "case when {0} is null then null when {0} <= 0 or {0} >= 1 then 0.0 else -({0} * log2({0}) + (1 - {0}) * log2(1 - {0})) end"
_ENT = f", x as (select model, {_BITS.format('physician_interview_consensus')} - {_BITS.format('physician_survey_consensus')} as a, {_BITS.format('llm_correct_context')} - {_BITS.format('llm_context_free')} as b from cells) select model, count(*) as n, case when count(*) >= 3 then corr(a, b) end as r from x where a is not null and b is not null group by model"


@entry(sql(_ENT, "cells"), "r")
def e17_entropy_corr(spark, sf):
    return G.entropy_correlation(cells(spark, sf), ["model"])


_ICC = """, l0 as (select sheet, patient, item, physician, row_id, diagnoses as v0 from rv where sheet = 'test' and patient is not null and item is not null and physician is not null),
l as (select sheet, item as target, dense_rank() over (partition by sheet, patient, item order by physician) as rater, patient, v0 from l0),
own as (select patient, target, rater, avg(v0) as v from l where v0 is not null and rater <= 2 group by all),
k as (select patient, count(distinct rater) as k from own group by patient), f0 as (select own.*, k, count(*) over (partition by own.patient, target) as n_ from own join k on k.patient = own.patient), f as (select * from f0 where n_ = k),
m as (select *, avg(v) over (partition by patient) as g, avg(v) over (partition by patient, target) as t, avg(v) over (partition by patient, rater) as r from f),
s as (select patient, count(distinct target) as n, max(k) as k, sum((t - g) * (t - g)) as ss_t, sum((r - g) * (r - g)) as ss_r, sum((v - t - r + g) * (v - t - r + g)) as ss_e from m group by patient),
q as (select patient, n as n_targets, k as n_raters, ss_t / nullif(n - 1, 0) as ms_t, ss_r / nullif(k - 1, 0) as ms_r, ss_e / nullif((n - 1) * (k - 1), 0) as ms_e from s),
z as (select *, ms_t + (n_raters - 1) * ms_e + n_raters * (ms_r - ms_e) / n_targets as bottom from q)
select patient, n_targets, n_raters, case when n_targets > 1 and n_raters > 1 and abs(bottom) >= 1e-12 then (ms_t - ms_e) / bottom end as icc from z"""


@entry(sql(_ICC, "rv"), "icc")
def e18_icc(spark, sf):
    from pyspark.sql import Window as W

    rows = sheet(spark, sf, "test").where("patient is not null and item is not null and physician is not null")
    ranked = rows.withColumn("rater", F.dense_rank().over(W.partitionBy("patient", "item").orderBy("physician"))).where("rater <= 2")
    return G.icc21(ranked, ["patient"], "item", "rater", "diagnoses")


@entry(" union all ".join(f"select '{c}' as category, * from ({sql(_ICC.replace('diagnoses as v0', f'{c} as v0'), 'rv')})" for c in CLASSES), "icc")
def e18_icc_all(spark, sf):
    from pyspark.sql import Window as W

    rows = sheet(spark, sf, "test").where("patient is not null and item is not null and physician is not null")
    ranked = rows.withColumn("rater", F.dense_rank().over(W.partitionBy("patient", "item").orderBy("physician"))).where("rater <= 2").persist()
    return reduce(DataFrame.unionByName, (G.icc21(ranked, ["patient"], "item", "rater", c).withColumn("category", F.lit(c)) for c in CLASSES))


@entry(sql("select category, count(*) as n, case when var_pop(p) + var_pop(y) + (avg(p) - avg(y)) * (avg(p) - avg(y)) > 1e-12 then 2 * covar_pop(p, y) / (var_pop(p) + var_pop(y) + (avg(p) - avg(y)) * (avg(p) - avg(y))) end as ccc from preds group by category", "preds"), "ccc")
def e19_ccc(spark, sf):
    return G.concordance(preds(spark, sf), _G, "p", "y")


_STR = f""", k as (select distinct lower(item) as item from rv where sheet = 'train' and item is not null), c as (select cells.*, case when k.item is null then 'novel' else 'repeated' end as stratum from cells left join k on k.item = lower(cells.item_text))"""


@entry(sql(f"{_STR} select model, stratum, count(distinct item_text) as n_items, count(*) as n_cells, avg(case when delta_physician <> 0 then {_SIGN} end) as agreement, avg({_IMP}) as improvement from c group by model, stratum", "cells"), "agreement improvement")
def e23_stratum_comparison(spark, sf):
    from tidewright.operators.fuzzy import strata

    known = sheet(spark, sf, "train").select("item")
    items = strata(cells(spark, sf).select("item_text").distinct(), "item_text", known).where("stratum = 'repeated'").select(F.col("item_text").alias("item"))
    return G.stratum_comparison(cells(spark, sf), items, ["model"])


@entry(sql(f"{_STR}, v as (select model, stratum, round({_IMP}, 9) as d from c where {_BI}), r as (select *, rank() over (partition by model order by d) + (count(*) over (partition by model, d) - 1) / 2.0 as k from v) select model, count_if(stratum = 'novel') as n1, count_if(stratum <> 'novel') as n2, sum(case when stratum = 'novel' then k else 0.0 end) - count_if(stratum = 'novel') * (count_if(stratum = 'novel') + 1) / 2.0 as u from r group by model", "cells"), "u")
def e23_rank_sum(spark, sf):
    from tidewright.operators.fuzzy import strata

    marked = strata(cells(spark, sf).where(_BI), "item_text", sheet(spark, sf, "train").select("item")).withColumn("d", F.round(F.expr(_IMP), 9))
    return G.rank_sum(marked, ["model"], "d", F.col("stratum") == "novel")


@entry(sql(" union all ".join(f"select '{c}' as category, least(greatest(count(*) / (2.0 * greatest(sum({c}), 1)), 1.0), 50.0) as weight from cons where sheet = 'train'" for c in CLASSES), "cons"), "weight")
def a26_class_weights(spark, sf):
    from tidewright.operators.features import class_weight

    long = unpivoted(consensus(spark, sf, "train"), ["patient", "item"], CLASSES)
    return long.groupBy("category").agg(F.sum("score").alias("m"), F.count(F.lit(1)).alias("n")).select("category", class_weight(F.coalesce("m", F.lit(0.0)), F.col("n"), "balanced").alias("weight"))
