"""Registered queries: EDA and report tables (A4-A8, A25, A26, A28, P14, P16, P17,
R2-R4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import truncate_label
from tidemark.operators import eda
from tidemark.operators.lookup import short_label
from tidemark.plans.common import round_doubles
from tidemark.plans.ingest import master_table
from tidemark.plans.oracle_views import rounded, with_views
from tidemark.plans.registry import register
from tidemark.sources import tables as T

# Short labels of the stand-in topics (event types).
EVENT_SHORT_LABELS = {"purchase": "Buy", "signup": "Join", "error": "Err"}
LABEL_CHARS = 8


@register("a4_target_distribution", with_views(rounded("""
SELECT spread_target_shift_24, count(*) AS count, count(*) / sum(count(*)) OVER () * 100 AS pct
FROM v_master_h GROUP BY 1""", ["pct"]), "v_master_h"))
def a4_target_distribution(spark, sf_dir):
    m = master_table(T.energy_hourly(spark, sf_dir))
    return round_doubles(eda.value_counts(m, "spread_target_shift_24"))


@register("a4_source_distribution", with_views(rounded("""
SELECT source, count(*) AS count, count(*) / sum(count(*)) OVER () * 100 AS pct
FROM v_news WHERE source IS NOT NULL GROUP BY 1""", ["pct"]), "v_news"))
def a4_source_distribution(spark, sf_dir):
    return round_doubles(eda.value_counts(T.news(spark, sf_dir), "source"))


@register("a5_top_topics_short_labels", with_views(rounded("""
WITH g AS (SELECT topic, count(*) AS count FROM v_topic_news WHERE topic IS NOT NULL GROUP BY 1),
t AS (SELECT * FROM g ORDER BY count DESC, topic LIMIT 3),
s AS (SELECT *, CAST(row_number() OVER (ORDER BY count DESC, topic) AS INT) AS rank,
             count / sum(count) OVER () * 100 AS pct_of_shown FROM t)
SELECT topic, count, rank, pct_of_shown,
       coalesce(CASE topic WHEN 'purchase' THEN 'Buy' WHEN 'signup' THEN 'Join' WHEN 'error' THEN 'Err' END,
                topic) AS short_label,
       CASE WHEN length(topic) > 8 THEN substr(topic, 1, 5) || '...' ELSE topic END AS display_label
FROM s""", ["pct_of_shown"]), "v_topic_news"))
def a5_top_topics_short_labels(spark, sf_dir):
    t = eda.top_n_counts(T.topic_news(spark, sf_dir), "topic", 3)
    t = short_label(t, "topic", EVENT_SHORT_LABELS)
    return round_doubles(t.withColumn("display_label", truncate_label("topic", LABEL_CHARS)))


@register("a6_mean_price_by_hour", with_views(rounded("""
SELECT CAST(hour(ts) AS BIGINT) AS hour, avg(spot) AS mean_spot FROM v_energy_h GROUP BY 1""", ["mean_spot"]),
    "v_energy_h"))
def a6_mean_price_by_hour(spark, sf_dir):
    e = T.energy_hourly(spark, sf_dir)
    return round_doubles(eda.mean_by(e, F.hour("ts").cast("bigint").alias("hour"), "spot", "mean_spot"))


@register("a6_mean_price_by_weekday", with_views(rounded("""
SELECT CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, avg(spot) AS mean_spot FROM v_energy_d GROUP BY 1""",
    ["mean_spot"]), "v_energy_d"))
def a6_mean_price_by_weekday(spark, sf_dir):
    e = T.energy_daily(spark, sf_dir)
    return round_doubles(eda.mean_by(e, F.weekday("ts").cast("bigint").alias("day_of_week"), "spot", "mean_spot"))


@register("a7_hourly_coverage_peak", with_views("""
WITH g AS (SELECT CAST(hour(publishedAt) AS BIGINT) AS hour, count(*) AS count FROM v_news GROUP BY 1)
SELECT hour, count, row_number() OVER (ORDER BY count DESC, hour) = 1 AS is_peak FROM g""", "v_news"))
def a7_hourly_coverage_peak(spark, sf_dir):
    return eda.hourly_counts_with_peak(T.news(spark, sf_dir), "publishedAt")


@register("a8_daily_volume", with_views("""
SELECT date_trunc('day', publishedAt) AS day, count(*) AS count FROM v_news GROUP BY 1""", "v_news"))
def a8_daily_volume(spark, sf_dir):
    return eda.daily_counts(T.news(spark, sf_dir), "publishedAt")


@register("a26_load_histogram", with_views(rounded("""
WITH s AS (SELECT min(load) AS lo, max(load) AS hi FROM v_energy_h),
b AS (SELECT CAST(least(floor((e.load - s.lo) * (50 / CASE WHEN s.hi > s.lo THEN s.hi - s.lo ELSE 1.0 END)), 49) AS BIGINT) AS bin
      FROM v_energy_h e, s WHERE e.load IS NOT NULL),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
edges AS (SELECT r.bin, s.lo + r.bin * ((s.hi - s.lo) / 50) AS lo,
                 CASE WHEN r.bin = 49 THEN s.hi ELSE s.lo + (r.bin + 1) * ((s.hi - s.lo) / 50) END AS hi
          FROM range(50) r(bin), s)
SELECT edges.bin, edges.lo, edges.hi, CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM edges LEFT JOIN c USING (bin)""", ["lo", "hi"]), "v_energy_h"))
def a26_load_histogram(spark, sf_dir):
    return round_doubles(eda.histogram(T.energy_hourly(spark, sf_dir), "load", 50))


CORR_COLS = ["spot", "da", "load", "real_spread_abs", "price_lag_24", "load_lag_24"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[: i + 1]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 "
                         f"THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END AS corr "
                         f"FROM v_master_h")
    return rounded(" UNION ALL ".join(parts), ["corr"])


@register("a25_correlation_matrix", with_views(_corr_sql(), "v_master_h"))
def a25_correlation_matrix(spark, sf_dir):
    m = master_table(T.energy_hourly(spark, sf_dir))
    return round_doubles(eda.correlation_matrix(m, CORR_COLS))


@register("a28_topic_stats", with_views(rounded("""
SELECT avg(score) AS mean_score, quantile_cont(score, 0.5) AS median_score,
       count(*) FILTER (WHERE topic = 'error') / count(*) * 100 AS other_pct,
       count(DISTINCT topic) AS n_topics, count(topic) AS n_classified
FROM v_topic_news""", ["mean_score", "median_score", "other_pct"]), "v_topic_news"))
def a28_topic_stats(spark, sf_dir):
    return round_doubles(eda.topic_stats(T.topic_news(spark, sf_dir), "topic", "score", T.OTHER_TOPIC_EVENTS))


KDE_FEATURES = ["spot", "load", "real_spread_abs"]


def _kde_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT spread_target_shift_24 AS g, '{f}' AS feature, {f} AS x FROM v_master_h"
                               for f in KDE_FEATURES)
    return f"""l AS ({parts}),
st AS (SELECT g, feature, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h,
              min(x) - 0.5 * (max(x) - min(x)) AS g0, 2.0 * (max(x) - min(x)) / 999 AS step
       FROM l GROUP BY 1, 2 HAVING count(*) > 1 AND stddev_samp(x) > 0),
gr AS (SELECT st.*, r.gi, st.g0 + r.gi * st.step AS gx FROM st, range(1000) r(gi))"""


@register("a27_kde_density", with_views(rounded("""
SELECT gr.feature, gr.g AS spread_target_shift_24, CAST(gr.gi AS BIGINT) AS grid_index, gr.gx AS x,
       sum(exp(-0.5 * ((gr.gx - l.x) / gr.h) * ((gr.gx - l.x) / gr.h))) / (gr.n * gr.h * sqrt(2 * pi())) AS density
FROM gr JOIN l ON l.g = gr.g AND l.feature = gr.feature
GROUP BY gr.feature, gr.g, gr.gi, gr.gx, gr.n, gr.h""", ["x", "density"]), "v_master_h", extra=[_kde_sql()]))
def a27_kde_density(spark, sf_dir):
    m = master_table(T.energy_hourly(spark, sf_dir))
    return round_doubles(eda.kde_density(m, KDE_FEATURES, "spread_target_shift_24"))
