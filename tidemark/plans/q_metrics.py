"""Registered queries: classification statistics and model comparison (A14-A24,
A32, A33, J8, J9, P19, P23, K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import argmax_array, erfc_sql, mix_uniform_sql, poisson1_cdf_table
from tidemark.operators import classify_metrics as cm
from tidemark.operators import inference_stats as st
from tidemark.plans.common import round_doubles
from tidemark.plans.oracle_views import rounded, with_views
from tidemark.plans.registry import register
from tidemark.sources import tables as T

CLASSES = [0, 1, 2]

_PER_CLASS = """
e AS (SELECT model, y_true AS label, 1 AS t, CAST(y_true = y_pred AS INT) AS tp, 0 AS pp FROM {src}
      UNION ALL SELECT model, y_pred, 0, 0, 1 FROM {src}),
c AS (SELECT model, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(t) AS BIGINT) AS support,
             CAST(sum(pp) AS BIGINT) AS predicted FROM e GROUP BY ALL)"""


@register("a14_confusion_matrix", with_views("""
WITH cells AS (SELECT m.model, CAST(a.y AS BIGINT) AS y_true, CAST(b.y AS BIGINT) AS y_pred
               FROM (SELECT DISTINCT model FROM v_pred) m, range(3) a(y), range(3) b(y)),
cnt AS (SELECT model, y_true, y_pred, count(*) AS n FROM v_pred GROUP BY ALL)
SELECT cells.model, cells.y_true, cells.y_pred, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM cells LEFT JOIN cnt USING (model, y_true, y_pred)
""", "v_pred"))
def a14_confusion_matrix(spark, sf_dir):
    return cm.confusion_matrix(T.predictions(spark, sf_dir), CLASSES)


@register("a16_classification_report", with_views(rounded("""
WITH """ + _PER_CLASS.format(src="v_pred") + """,
per AS (SELECT model, CAST(label AS VARCHAR) AS label,
               coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
               coalesce(tp / nullif(support, 0), 0.0) AS recall,
               coalesce(2 * tp / nullif(2 * tp + (predicted - tp) + (support - tp), 0), 0.0) AS f1,
               support, tp FROM c)
SELECT model, label, precision, recall, f1, support FROM per
UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT)
          FROM per GROUP BY model
UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support),
          sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT)
          FROM per GROUP BY model
UNION ALL SELECT model, 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT)
          FROM per GROUP BY model
""", ["precision", "recall", "f1"]), "v_pred"))
def a16_classification_report(spark, sf_dir):
    return round_doubles(cm.classification_report(T.predictions(spark, sf_dir)))


@register("a17_accuracy_macro_f1", with_views(rounded("""
WITH """ + _PER_CLASS.format(src="v_pred") + """
SELECT model, sum(tp) / sum(support) AS accuracy,
       avg(coalesce(2 * tp / nullif(predicted + support, 0), 0.0)) AS macro_f1,
       CAST(sum(support) AS BIGINT) AS n
FROM c GROUP BY model
""", ["accuracy", "macro_f1"]), "v_pred"))
def a17_accuracy_macro_f1(spark, sf_dir):
    return round_doubles(cm.accuracy_macro_f1(T.predictions(spark, sf_dir)))


@register("a18_prediction_distribution", with_views(rounded("""
SELECT model, y_pred, count(*) AS count,
       count(*) / sum(count(*)) OVER (PARTITION BY model) * 100 AS share_pct
FROM v_pred GROUP BY model, y_pred
""", ["share_pct"]), "v_pred"))
def a18_prediction_distribution(spark, sf_dir):
    return round_doubles(cm.prediction_distribution(T.predictions(spark, sf_dir)))


@register("j8_unseen_predicted_labels", with_views("""
SELECT DISTINCT p.y_pred AS label, p.model FROM v_pred p
WHERE p.y_true < 2 AND p.y_pred NOT IN (SELECT DISTINCT y_true FROM v_pred WHERE y_true < 2)
""", "v_pred"))
def j8_unseen_predicted_labels(spark, sf_dir):
    """Over the orders that are open or finished: the third status never occurs in the truth there."""
    pred = T.predictions(spark, sf_dir).filter(F.col("y_true") < 2)
    return cm.unseen_predicted_labels(pred).select("label", "model")


@register("p19_label_index", with_views("""
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS class_index
FROM (SELECT DISTINCT y_true AS label FROM v_pred)
""", "v_pred"))
def p19_label_index(spark, sf_dir):
    return cm.label_index(T.predictions(spark, sf_dir).filter(F.col("model") == "signal"))


_ARGMAX_SQL = "CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS BIGINT)"


@register("p23_neutral_override", with_views(f"""
SELECT model, row_id, {_ARGMAX_SQL} AS argmax_pred,
       CAST(CASE WHEN p1 >= 0.25 THEN 1 ELSE {_ARGMAX_SQL} END AS BIGINT) AS override_pred
FROM v_pred
""", "v_pred"))
def p23_neutral_override(spark, sf_dir):
    p = T.predictions(spark, sf_dir)
    return p.select("model", "row_id", argmax_array("proba").alias("argmax_pred"),
                    cm.neutral_override("proba", 1, 0.25).alias("override_pred"))


_PAIRED_SQL = """
paired AS (SELECT row_id, max(y_true) AS y_true,
                  max(CASE WHEN model = 'signal' THEN y_pred END) AS pa,
                  max(CASE WHEN model = 'baseline' THEN y_pred END) AS pb
           FROM v_pred GROUP BY row_id)"""


@register("a19_mcnemar", with_views(rounded(f"""
WITH t AS (SELECT count(*) FILTER (WHERE pa = y_true AND pb = y_true) AS both_correct,
                  count(*) FILTER (WHERE pa = y_true AND pb <> y_true) AS only_a_correct,
                  count(*) FILTER (WHERE pa <> y_true AND pb = y_true) AS only_b_correct,
                  count(*) FILTER (WHERE pa <> y_true AND pb <> y_true) AS both_wrong,
                  avg(CAST(pa = y_true AS DOUBLE)) AS accuracy_a,
                  avg(CAST(pb = y_true AS DOUBLE)) AS accuracy_b
           FROM paired),
s AS (SELECT *, CASE WHEN only_a_correct + only_b_correct > 0
                     THEN power(abs(only_a_correct - only_b_correct) - 1, 2) / (only_a_correct + only_b_correct)
                END AS mcnemar_statistic FROM t)
SELECT *, {erfc_sql('sqrt(mcnemar_statistic / 2.0)')} AS mcnemar_p_value FROM s
""", ["accuracy_a", "accuracy_b", "mcnemar_statistic", "mcnemar_p_value"]), "v_pred", extra=[_PAIRED_SQL]))
def a19_mcnemar(spark, sf_dir):
    return round_doubles(st.mcnemar(st.paired_predictions(T.predictions(spark, sf_dir))))


def _poisson_case(u: str) -> str:
    parts = " ".join(f"WHEN {u} < {c!r} THEN {k}" for k, c in enumerate(poisson1_cdf_table()))
    return f"CASE {parts} ELSE 13 END"


N_BOOT = 1000


def _boot_sql() -> str:
    u = mix_uniform_sql(42, "r.rep", "coalesce(row_id, 0)")
    body = f"""
x AS (SELECT r.rep, CAST(pa = y_true AS DOUBLE) AS ca, CAST(pb = y_true AS DOUBLE) AS cb, {u} AS u
      FROM paired CROSS JOIN range({N_BOOT}) r(rep)),
w AS (SELECT rep, ca, cb, {_poisson_case('u')} AS w FROM x),
rr AS (SELECT rep, sum(w) AS sw, sum(w * ca) AS sa, sum(w * cb) AS sb FROM w GROUP BY rep HAVING sum(w) > 0),
l AS (SELECT 'a' AS side, sa / sw AS score FROM rr UNION ALL SELECT 'b', sb / sw FROM rr)"""
    return body


@register("a20_bootstrap_ci", with_views(rounded("""
SELECT side, avg(score) AS mean, quantile_cont(score, 0.025) AS lower, quantile_cont(score, 0.975) AS upper,
       count(*) AS n_replicates
FROM l GROUP BY side
""", ["mean", "lower", "upper"]), "v_pred", extra=[_PAIRED_SQL, _boot_sql()]))
def a20_bootstrap_ci(spark, sf_dir):
    paired = st.paired_predictions(T.predictions(spark, sf_dir))
    return round_doubles(st.bootstrap_accuracy(paired, N_BOOT, 42, 0.95))


_CI_SQL = """
ci AS (SELECT side, avg(score) AS mean, quantile_cont(score, 0.025) AS lower,
              quantile_cont(score, 0.975) AS upper FROM l GROUP BY side),
v AS (SELECT max(CASE WHEN side = 'a' THEN mean END) AS a_mean, max(CASE WHEN side = 'a' THEN lower END) AS a_lo,
             max(CASE WHEN side = 'a' THEN upper END) AS a_hi, max(CASE WHEN side = 'b' THEN mean END) AS b_mean,
             max(CASE WHEN side = 'b' THEN lower END) AS b_lo, max(CASE WHEN side = 'b' THEN upper END) AS b_hi
      FROM ci)"""


@register("a21_ci_overlap_verdict", with_views(rounded("""
SELECT *, a_mean - b_mean AS difference,
       CASE WHEN a_lo > b_hi THEN 'signal better, intervals disjoint'
            WHEN a_hi < b_lo THEN 'baseline better, intervals disjoint' ELSE 'intervals overlap' END AS verdict
FROM v""", ["a_mean", "a_lo", "a_hi", "b_mean", "b_lo", "b_hi", "difference"]),
    "v_pred", extra=[_PAIRED_SQL, _boot_sql(), _CI_SQL]))
def a21_ci_overlap_verdict(spark, sf_dir):
    paired = st.paired_predictions(T.predictions(spark, sf_dir))
    ci = st.bootstrap_accuracy(paired, N_BOOT, 42, 0.95)
    return round_doubles(st.ci_overlap_verdict(ci))


def _ovo_sql() -> str:
    parts = []
    for a, b in [(0, 1), (0, 2), (1, 2)]:
        for pos in (a, b):
            parts.append(f"SELECT model, '{a}-{b}' AS pair, {pos} AS pos_class, p{pos} AS score, "
                         f"CAST(y_true = {pos} AS BIGINT) AS is_pos FROM v_pred WHERE y_true IN ({a}, {b})")
    e = "e AS (" + " UNION ALL ".join(parts) + ")"
    return e + """,
g AS (SELECT model, pair, pos_class, score, sum(is_pos) AS pos, sum(1 - is_pos) AS neg FROM e GROUP BY ALL),
a AS (SELECT model, pair, pos_class,
             sum(pos * (coalesce(neg_below, 0) + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc
      FROM (SELECT *, sum(neg) OVER (PARTITION BY model, pair, pos_class ORDER BY score
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below FROM g)
      GROUP BY ALL)"""


@register("a22_ovo_auc", with_views(rounded("""
SELECT model, avg(pair_auc) AS auc_ovo FROM (SELECT model, pair, avg(auc) AS pair_auc FROM a GROUP BY ALL)
GROUP BY model""", ["auc_ovo"]), "v_pred", extra=[_ovo_sql()]))
def a22_ovo_auc(spark, sf_dir):
    return round_doubles(cm.ovo_auc(T.predictions(spark, sf_dir), CLASSES))


def _roc_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT model, CAST({c} AS BIGINT) AS cls, p{c} AS score, CAST(y_true = {c} AS BIGINT) AS is_pos FROM v_pred"
        for c in CLASSES)
    return f"""x AS ({parts}),
g AS (SELECT model, cls, score, sum(is_pos) AS pos, sum(1 - is_pos) AS neg FROM x GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY model, cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (PARTITION BY model, cls ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             sum(pos) OVER (PARTITION BY model, cls) AS P, sum(neg) OVER (PARTITION BY model, cls) AS N FROM g),
t AS (SELECT model, cls, score, tp / nullif(P, 0) AS tpr, fp / nullif(N, 0) AS fpr FROM r),
tr AS (SELECT *, (fpr - coalesce(lag(fpr) OVER o, 0.0)) * (tpr + coalesce(lag(tpr) OVER o, 0.0)) / 2 AS trap
       FROM t WINDOW o AS (PARTITION BY model, cls ORDER BY score DESC))"""


@register("a23_roc_points", with_views(rounded("""
SELECT model, cls, score AS threshold, tpr, fpr, sum(trap) OVER (PARTITION BY model, cls) AS auc FROM tr
""", ["threshold", "tpr", "fpr", "auc"]), "v_pred", extra=[_roc_sql()]))
def a23_roc_points(spark, sf_dir):
    return round_doubles(cm.roc_points(T.predictions(spark, sf_dir), CLASSES))


@register("a23_macro_roc", with_views(rounded("""
WITH c0 AS (SELECT model, cls, fpr, tpr FROM t WHERE fpr IS NOT NULL AND tpr IS NOT NULL
            UNION ALL SELECT DISTINCT model, cls, 0.0, 0.0 FROM t),
c AS (SELECT model, cls, fpr, max(tpr) AS hi, min(tpr) AS lo FROM c0 GROUP BY ALL),
f AS (SELECT g.model, k.cls, g.fpr, c.hi, c.lo, CASE WHEN c.hi IS NOT NULL THEN g.fpr END AS xk
      FROM (SELECT DISTINCT model, fpr FROM c) g JOIN (SELECT DISTINCT model, cls FROM c) k USING (model)
      LEFT JOIN c ON c.model = g.model AND c.cls = k.cls AND c.fpr = g.fpr),
n AS (SELECT *, last_value(xk IGNORE NULLS) OVER b AS x0, last_value(hi IGNORE NULLS) OVER b AS y0,
             first_value(xk IGNORE NULLS) OVER a AS x1, first_value(lo IGNORE NULLS) OVER a AS y1
      FROM f WINDOW b AS (PARTITION BY model, cls ORDER BY fpr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    a AS (PARTITION BY model, cls ORDER BY fpr ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
m AS (SELECT model, fpr, avg(coalesce(hi, y0 + (y1 - y0) * (fpr - x0) / (x1 - x0), y0)) AS tpr FROM n GROUP BY ALL),
p AS (SELECT *, (fpr - lag(fpr) OVER o) * (tpr + lag(tpr) OVER o) / 2 AS part FROM m
      WINDOW o AS (PARTITION BY model ORDER BY fpr))
SELECT model, fpr, tpr, sum(coalesce(part, 0.0)) OVER (PARTITION BY model) AS macro_auc FROM p
""", ["fpr", "tpr", "macro_auc"]), "v_pred", extra=[_roc_sql()]))
def a23_macro_roc(spark, sf_dir):
    return round_doubles(cm.macro_roc(cm.roc_points(T.predictions(spark, sf_dir), CLASSES), classes=CLASSES))


@register("a24_class_weights", with_views(rounded("""
SELECT label, count, pow(sum(count) OVER () / (count(*) OVER () * greatest(count, 1)), 2.0) AS weight
FROM (SELECT y_true AS label, count(*) AS count FROM v_pred WHERE model = 'signal' GROUP BY 1)
""", ["weight"]), "v_pred"))
def a24_class_weights(spark, sf_dir):
    train = T.predictions(spark, sf_dir).filter(F.col("model") == "signal")
    return round_doubles(cm.class_weights(train, "y_true", power=2.0))


@register("f22_error_class_weights", with_views(rounded("""
WITH t AS (SELECT y_pred AS part, y_true AS label, count(*) AS count FROM v_pred WHERE model = 'signal' AND y_true <> y_pred GROUP BY 1, 2),
spine AS (SELECT DISTINCT t.part, v.label FROM t, (VALUES (0), (1), (2)) v(label)),
f AS (SELECT spine.part, spine.label, coalesce(t.count, 0) AS count FROM spine LEFT JOIN t USING (part, label))
SELECT CAST(part AS BIGINT) AS predicted, CAST(label AS BIGINT) AS label, count,
       sum(count) OVER (PARTITION BY part) / (3 * greatest(count, 1)) AS weight FROM f""", ["weight"]), "v_pred"))
def f22_error_class_weights(spark, sf_dir):
    """Weights of the true classes among one model's errors, per predicted class: the predicted class
    itself never occurs there, so every table has a class without rows."""
    wrong = T.predictions(spark, sf_dir).filter((F.col("model") == "signal") & (F.col("y_true") != F.col("y_pred")))
    return round_doubles(cm.class_weights(wrong.withColumnRenamed("y_pred", "predicted"), "y_true", labels=CLASSES, keys=["predicted"]))


def _calib_sql() -> str:
    parts = []
    for c in CLASSES:
        b = " + ".join(f"CAST(p{c} > {i / 10!r} AS INT)" for i in range(1, 10))
        parts.append(f"SELECT model, CAST({c} AS BIGINT) AS cls, p{c} AS p, CAST(y_true = {c} AS DOUBLE) AS obs, "
                     f"CAST({b} AS BIGINT) AS bin FROM v_pred")
    return "x AS (" + " UNION ALL ".join(parts) + ")"


@register("a32_calibration_curve", with_views(rounded("""
SELECT model, cls, bin, avg(p) AS mean_predicted, avg(obs) AS fraction_positive, count(*) AS count
FROM x GROUP BY ALL""", ["mean_predicted", "fraction_positive"]), "v_pred", extra=[_calib_sql()]))
def a32_calibration_curve(spark, sf_dir):
    return round_doubles(cm.calibration_curve(T.predictions(spark, sf_dir), classes=CLASSES))


def _sweep_sql() -> str:
    import numpy as np
    ts = np.linspace(0.1, 0.5, 20).tolist()
    vals = ", ".join(f"({i}, {t!r})" for i, t in enumerate(ts))
    return f"""th AS (SELECT * FROM (VALUES {vals}) v(t_idx, threshold)),
xp AS (SELECT p.model, th.t_idx, th.threshold, p.y_true,
              CAST(CASE WHEN p.p1 >= th.threshold THEN 1 ELSE {_ARGMAX_SQL} END AS BIGINT) AS y_pred
       FROM v_pred p CROSS JOIN th),
e AS (SELECT model, t_idx, threshold, y_true AS label, 1 AS t, CAST(y_true = y_pred AS INT) AS tp FROM xp
      UNION ALL SELECT model, t_idx, threshold, y_pred, 0, 0 FROM xp),
c AS (SELECT model, t_idx, threshold, label, sum(tp) AS tp, sum(t) AS support, count(*) - sum(t) AS predicted
      FROM e GROUP BY ALL),
s AS (SELECT model, t_idx, threshold, sum(tp) / sum(support) AS accuracy,
             avg(coalesce(2 * tp / nullif(predicted + support, 0), 0.0)) AS macro_f1 FROM c GROUP BY ALL)"""


@register("a33_threshold_sweep", with_views(rounded("""
SELECT model, CAST(t_idx AS INT) AS t_idx, threshold, accuracy, macro_f1,
       row_number() OVER (PARTITION BY model ORDER BY round(macro_f1, 12) DESC, t_idx) = 1 AS is_best
FROM s""", ["threshold", "accuracy", "macro_f1"]), "v_pred", extra=[_sweep_sql()]))
def a33_threshold_sweep(spark, sf_dir):
    return round_doubles(cm.threshold_sweep(T.predictions(spark, sf_dir)))


@register("p26_residuals", with_views("""
SELECT model, row_id, CAST(y_pred - y_true AS BIGINT) AS residual FROM v_pred""", "v_pred"))
def p26_residuals(spark, sf_dir):
    p = T.predictions(spark, sf_dir)
    return p.select("model", "row_id", (F.col("y_pred") - F.col("y_true")).cast("bigint").alias("residual"))


def _boot_f1_sql() -> str:
    u = mix_uniform_sql(42, "r.rep", "coalesce(p.row_id, 0)")
    return f"""
xw AS (SELECT p.model, r.rep, p.y_true, p.y_pred, {_poisson_case(u)} AS w
       FROM v_pred p CROSS JOIN range({N_BOOT}) r(rep)),
cells AS (SELECT model, rep, y_true, y_pred, sum(w) AS w FROM xw GROUP BY ALL HAVING sum(w) > 0),
e AS (SELECT model, rep, y_true AS c, w AS t, CASE WHEN y_true = y_pred THEN w ELSE 0 END AS tp, 0 AS pp FROM cells
      UNION ALL SELECT model, rep, y_pred, 0, 0, w FROM cells),
pc AS (SELECT model, rep, c, sum(tp) AS tp, sum(t) AS sup, sum(pp) AS prd FROM e GROUP BY ALL),
sc AS (SELECT model, rep, avg(coalesce(2 * tp / nullif(sup + prd, 0), 0.0)) AS score FROM pc GROUP BY ALL)"""


@register("a20_bootstrap_macro_f1", with_views(rounded("""
SELECT model, avg(score) AS mean, quantile_cont(score, 0.025) AS lower, quantile_cont(score, 0.975) AS upper,
       count(*) AS n_replicates
FROM sc GROUP BY model""", ["mean", "lower", "upper"]), "v_pred", extra=[_boot_f1_sql()]))
def a20_bootstrap_macro_f1(spark, sf_dir):
    """A20/U1 with the macro-F1 metric (confusion-cell bootstrap)."""
    return round_doubles(st.bootstrap_confusion_metric(T.predictions(spark, sf_dir), "macro_f1", N_BOOT, 42))
