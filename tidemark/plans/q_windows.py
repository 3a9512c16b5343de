"""Registered queries: windows, splits, folds, weekly resampling (W*, A9, A10, J3, R5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.timecal import week_label
from tidemark.operators import decay, eda, split, windows
from tidemark.plans.common import round_doubles
from tidemark.plans.ingest import master_table
from tidemark.plans.oracle_views import rounded, with_views
from tidemark.plans.registry import register
from tidemark.sources import tables as T

WEEK_SQL = "(CAST(date_trunc('week', {c}) AS TIMESTAMP) + INTERVAL 6 DAY)"


def _wk(c: str) -> str:
    return WEEK_SQL.format(c=c)


@register("w9_chrono_split", with_views("""
SELECT series_id, ts, CAST(i AS BIGINT) AS row_index,
       CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train'
            WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i,
             count(*) OVER (PARTITION BY series_id) AS n FROM v_master_h)
""", "v_master_h"))
def w9_chrono_split(spark, sf_dir):
    m = master_table(T.energy_hourly(spark, sf_dir)).select("series_id", "ts")
    return split.chrono_split(m).select("series_id", "ts", "row_index", "split")


@register("w10_expanding_folds", with_views("""
SELECT series_id, ts, CAST(i AS BIGINT) AS row_index, CAST(f.fold AS BIGINT) AS fold,
       CASE WHEN i < 336 + f.fold * 72 THEN 'train' ELSE 'test' END AS role
FROM (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i
      FROM v_master_d) r
CROSS JOIN range(8) f(fold)
WHERE i < 336 + (f.fold + 1) * 72
""", "v_master_d"))
def w10_expanding_folds(spark, sf_dir):
    m = master_table(T.energy_daily(spark, sf_dir)).select("series_id", "ts")
    return split.expanding_folds(m, n_splits=8, step=72, min_train=336) \
        .select("series_id", "ts", "row_index", "fold", "role")


@register("w11_time_series_folds", with_views("""
SELECT series_id, ts, CAST(i AS BIGINT) AS row_index, CAST(f.fold AS BIGINT) AS fold,
       CASE WHEN i < n - (5 - f.fold) * (n // 6) THEN 'train' ELSE 'test' END AS role
FROM (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i,
             count(*) OVER (PARTITION BY series_id) AS n FROM v_master_d) r
CROSS JOIN range(5) f(fold)
WHERE i < n - (5 - f.fold - 1) * (n // 6)
""", "v_master_d"))
def w11_time_series_folds(spark, sf_dir):
    m = master_table(T.energy_daily(spark, sf_dir)).select("series_id", "ts")
    return split.time_series_folds(m, n_splits=5).select("series_id", "ts", "row_index", "fold", "role")


@register("w5_rolling_std", with_views(rounded("""
SELECT series_id, ts,
       stddev_samp(spot) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS spot_std_24,
       stddev_samp(spot) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS spot_std_168
FROM v_energy_h""", ["spot_std_24", "spot_std_168"]), "v_energy_h"))
def w5_rolling_std(spark, sf_dir):
    e = T.energy_hourly(spark, sf_dir).select("series_id", "ts", "spot")
    return round_doubles(windows.rolling_std(e, "spot", [24, 168], ["series_id"], ["ts"])
                         .select("series_id", "ts", "spot_std_24", "spot_std_168"))


@register("r1_spread_volatility", with_views(rounded("""
SELECT series_id, ts,
       stddev_samp(real_spread_abs) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS spread_std_24,
       stddev_samp(real_spread_abs) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS spread_std_168
FROM v_master_h WHERE real_spread_abs IS NOT NULL""", ["spread_std_24", "spread_std_168"]), "v_master_h"))
def r1_spread_volatility(spark, sf_dir):
    """R1, the volatility panel: rolling deviation of the spread over a day and a week of rows that have one."""
    m = master_table(T.energy_hourly(spark, sf_dir)).select("series_id", "ts", "real_spread_abs").where("real_spread_abs is not null")
    return round_doubles(windows.rolling_std(m, "real_spread_abs", [24, 168], ["series_id"], ["ts"]).select(
        "series_id", "ts", F.col("real_spread_abs_std_24").alias("spread_std_24"), F.col("real_spread_abs_std_168").alias("spread_std_168")))


@register("r1_spread_by_weekday", with_views(rounded("""
SELECT CAST(day_of_week AS BIGINT) AS day_of_week, avg(real_spread_abs) AS mean_spread FROM v_master_h GROUP BY 1""",
    ["mean_spread"]), "v_master_h"))
def r1_spread_by_weekday(spark, sf_dir):
    """R1, the weekday panel: mean spread by day of the week (0 = Monday)."""
    m = master_table(T.energy_hourly(spark, sf_dir))
    return round_doubles(eda.mean_by(m, F.col("day_of_week").cast("bigint").alias("day_of_week"), "real_spread_abs", "mean_spread"))


@register("a9_weekly_mean", with_views(rounded(f"""
WITH g AS (SELECT series_id, {_wk('ts')} AS week, avg(spot) AS spot, avg(load) AS load
           FROM v_energy_d GROUP BY 1, 2),
b AS (SELECT series_id, min({_wk('ts')}) AS lo, max({_wk('ts')}) AS hi FROM v_energy_d GROUP BY 1),
sp AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS week FROM b)
SELECT sp.series_id, sp.week, g.spot, g.load FROM sp LEFT JOIN g USING (series_id, week)
""", ["spot", "load"]), "v_energy_d"))
def a9_weekly_mean(spark, sf_dir):
    e = T.energy_daily(spark, sf_dir)
    return round_doubles(windows.weekly_mean(e, "ts", ["spot", "load"], ["series_id"])
                         .select("series_id", "week", "spot", "load"))


# Valence of the stand-in topics (event types) for the shocks table.
EVENT_VALENCE = {"purchase": 1, "signup": 1, "error": -1, "click": 0, "view": 0}


def _valence_sql() -> str:
    rows = ", ".join(f"('{k}', {v})" for k, v in EVENT_VALENCE.items())
    return f"val AS (SELECT * FROM (VALUES {rows}) v(topic, valence))"


@register("a10_weekly_sign_counts", with_views(f"""
WITH s AS (SELECT n.publishedAt, coalesce(val.valence, 0) AS valence
           FROM v_topic_news n LEFT JOIN val ON n.topic = val.topic
           WHERE coalesce(val.valence, 0) <> 0),
g AS (SELECT {_wk('publishedAt')} AS week,
             CAST(count(*) FILTER (WHERE valence = 1) AS BIGINT) AS positive_count,
             CAST(count(*) FILTER (WHERE valence = -1) AS BIGINT) AS negative_count
      FROM s GROUP BY 1),
b AS (SELECT min({_wk('publishedAt')}) AS lo, max({_wk('publishedAt')}) AS hi FROM s),
sp AS (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS week FROM b)
SELECT sp.week, coalesce(g.positive_count, 0) AS positive_count,
       coalesce(g.negative_count, 0) AS negative_count
FROM sp LEFT JOIN g USING (week)
""", "v_topic_news", extra=[_valence_sql()]))
def a10_weekly_sign_counts(spark, sf_dir):
    from tidemark.operators.lookup import valence_lookup
    n = T.topic_news(spark, sf_dir)
    shocks = valence_lookup(n, "topic", EVENT_VALENCE).filter(F.col("valence") != 0)
    return windows.weekly_sign_counts(shocks, "publishedAt", "valence") \
        .select("week", "positive_count", "negative_count")


# R5 stand-in: line numbers of lineitem as topics, shipped lines as articles, the
# daily series as price; the topic list is an explicit dimension (fixed values).
LINE_TOPICS = [f"ln{i}" for i in range(1, 8)]
ROLLING_WEEKS = 4


def _r5_spark(spark, sf_dir):
    from tidemark.operators.lookup import only
    li = T.table(spark, sf_dir, "lineitem")
    arts = li.select(F.col("l_shipdate").alias("publishedAt"),
                     F.concat(F.lit("ln"), F.col("l_linenumber").cast("string")).alias("topic"))
    energy = T.energy_daily(spark, sf_dir)
    targets = energy.select("ts").distinct()
    w = decay.decayed_topic_counts(arts, targets, 336, 0.05).withColumn("topic", only("topic", LINE_TOPICS, "topic"))
    # weekly mean over the target days of each week (absent (t, topic) = 0)
    tw = targets.groupBy(week_label("ts").alias("week")).agg(F.count(F.lit(1)).alias("n_t"))
    sums = (w.groupBy(week_label("ts").alias("week")).pivot("topic", LINE_TOPICS).agg(F.sum("weight")))
    spine = windows.week_spine(targets, "ts", [])
    wide = spine.join(tw, "week", "left").join(sums, "week", "left")
    stack = F.array(*[F.struct(F.lit(t).alias("topic"),
                               F.when(F.col("n_t").isNotNull(),
                                      F.coalesce(F.col(t), F.lit(0.0)) / F.col("n_t")).alias("tw"))
                      for t in LINE_TOPICS])
    topic_weekly = wide.select("week", F.explode(stack).alias("c")) \
        .select("week", F.col("c.topic").alias("topic"), F.col("c.tw").alias("topic_weekly"))
    spread = energy.withColumn("spread", F.col("spot") - F.col("da"))
    sw = windows.weekly_mean(spread, "ts", ["spread"], ["series_id"])
    sw = windows.first_difference(sw, "spread", ["series_id"], ["week"], "spread_change")
    j = topic_weekly.join(sw.select("series_id", "week", "spread_change"), "week", "inner")   # J3
    c = windows.rolling_pearson(j, "topic_weekly", "spread_change", ROLLING_WEEKS,
                                ["series_id", "topic"], ["week"], "corr")
    c = windows.normalise_by_max_abs(c, "corr", ["series_id", "topic"], "corr_norm")
    return c.select("series_id", "topic", "week", "topic_weekly", "spread_change", "corr", "corr_norm")


def _r5_sql() -> str:
    topics = ", ".join(f"('{t}')" for t in LINE_TOPICS)
    body = f"""
arts AS (SELECT l_shipdate AS publishedAt, 'ln' || CAST(l_linenumber AS VARCHAR) AS topic FROM lineitem),
tg AS (SELECT DISTINCT ts FROM v_energy_d),
w AS (SELECT tg.ts, a.topic, sum(exp(-0.05 * ((epoch_us(tg.ts) - epoch_us(a.publishedAt)) // 3600000000))) AS weight
      FROM tg JOIN arts a ON a.publishedAt <= tg.ts AND a.publishedAt >= tg.ts - INTERVAL 336 HOUR
      GROUP BY 1, 2),
tw AS (SELECT {_wk('ts')} AS week, count(*) AS n_t FROM tg GROUP BY 1),
ws AS (SELECT {_wk('ts')} AS week, topic, sum(weight) AS s FROM w GROUP BY 1, 2),
b AS (SELECT min({_wk('ts')}) AS lo, max({_wk('ts')}) AS hi FROM tg),
spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS week FROM b),
topics AS (SELECT * FROM (VALUES {topics}) t(topic)),
topic_weekly AS (
  SELECT spine.week, topics.topic,
         CASE WHEN tw.n_t IS NOT NULL THEN coalesce(ws.s, 0.0) / tw.n_t END AS topic_weekly
  FROM spine CROSS JOIN topics
  LEFT JOIN tw ON tw.week = spine.week
  LEFT JOIN ws ON ws.week = spine.week AND ws.topic = topics.topic),
sg AS (SELECT series_id, {_wk('ts')} AS week, avg(spot - da) AS spread FROM v_energy_d GROUP BY 1, 2),
sb AS (SELECT series_id, min({_wk('ts')}) AS lo, max({_wk('ts')}) AS hi FROM v_energy_d GROUP BY 1),
ssp AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS week FROM sb),
sw AS (SELECT ssp.series_id, ssp.week,
              sg.spread - lag(sg.spread) OVER (PARTITION BY ssp.series_id ORDER BY ssp.week) AS spread_change
       FROM ssp LEFT JOIN sg USING (series_id, week)),
j AS (SELECT sw.series_id, t.topic, t.week, t.topic_weekly, sw.spread_change
      FROM topic_weekly t JOIN sw ON t.week = sw.week),
c AS (
  SELECT *,
    CASE WHEN row_number() OVER w0 > {ROLLING_WEEKS} AND count(xv) OVER w >= 3
              AND stddev_samp(xv) OVER w > 0 AND stddev_samp(yv) OVER w > 0
         THEN greatest(-1.0, least(1.0, covar_samp(xv, yv) OVER w / (stddev_samp(xv) OVER w * stddev_samp(yv) OVER w)))
    END AS corr
  FROM (SELECT *, CASE WHEN topic_weekly IS NOT NULL AND spread_change IS NOT NULL THEN topic_weekly END AS xv,
               CASE WHEN topic_weekly IS NOT NULL AND spread_change IS NOT NULL THEN spread_change END AS yv
        FROM j)
  WINDOW w0 AS (PARTITION BY series_id, topic ORDER BY week),
         w AS (PARTITION BY series_id, topic ORDER BY week ROWS BETWEEN {ROLLING_WEEKS} PRECEDING AND 1 PRECEDING))"""
    return with_views(rounded("""
SELECT series_id, topic, week, topic_weekly, spread_change, corr,
       coalesce(abs(corr) / nullif(max(abs(corr)) OVER (PARTITION BY series_id, topic), 0), 0.0) AS corr_norm
FROM c""", ["topic_weekly", "spread_change", "corr", "corr_norm"]), "v_energy_d", extra=[body])


@register("r5_event_importance_matrix", _r5_sql())
def r5_event_importance_matrix(spark, sf_dir):
    return round_doubles(_r5_spark(spark, sf_dir))


@register("p28_tail_drop_alert", with_views(rounded("""
WITH t AS (SELECT series_id, spot, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS p
           FROM v_energy_d)
SELECT series_id, max(spot) FILTER (WHERE p = 20) AS first_value, max(spot) FILTER (WHERE p = 1) AS last_value,
       count(*) AS n_points,
       (max(spot) FILTER (WHERE p = 1) - max(spot) FILTER (WHERE p = 20)) / max(spot) FILTER (WHERE p = 20) * 100 AS change_pct,
       coalesce((max(spot) FILTER (WHERE p = 1) - max(spot) FILTER (WHERE p = 20)) / max(spot) FILTER (WHERE p = 20) * 100 < -5.0, false) AS drop_alert
FROM t WHERE p <= 20 GROUP BY series_id
""", ["first_value", "last_value", "change_pct"]), "v_energy_d"))
def p28_tail_drop_alert(spark, sf_dir):
    e = T.energy_daily(spark, sf_dir).select("series_id", "ts", "spot")
    return round_doubles(windows.tail_change(e, "spot", 20, ["series_id"], ["ts"], 5.0))



@register("r6_news_shocks_vs_price", with_views(rounded(f"""
WITH s AS (SELECT n.publishedAt, coalesce(val.valence, 0) AS valence
           FROM v_topic_news n LEFT JOIN val ON n.topic = val.topic
           WHERE coalesce(val.valence, 0) <> 0),
g AS (SELECT {_wk('publishedAt')} AS week,
             CAST(count(*) FILTER (WHERE valence = 1) AS BIGINT) AS positive_count,
             CAST(count(*) FILTER (WHERE valence = -1) AS BIGINT) AS negative_count
      FROM s GROUP BY 1),
b AS (SELECT min({_wk('publishedAt')}) AS lo, max({_wk('publishedAt')}) AS hi FROM s),
sp AS (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS week FROM b),
shocks AS (SELECT sp.week, coalesce(g.positive_count, 0) AS positive_count,
                  coalesce(g.negative_count, 0) AS negative_count FROM sp LEFT JOIN g USING (week)),
pg AS (SELECT {_wk('ts')} AS week, avg(spot) AS price FROM v_energy_h GROUP BY 1),
pb AS (SELECT min({_wk('ts')}) AS lo, max({_wk('ts')}) AS hi FROM v_energy_h),
psp AS (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS week FROM pb),
price AS (SELECT psp.week, pg.price FROM psp LEFT JOIN pg USING (week))
SELECT shocks.week, positive_count, negative_count, price
FROM shocks JOIN price USING (week)""", ["price"]), "v_topic_news", "v_energy_h", extra=[_valence_sql()]))
def r6_news_shocks_vs_price(spark, sf_dir):
    """Weekly positive/negative shock counts (P15, A10) next to the weekly mean
    price (A9), aligned on the common weeks (J3/SET4)."""
    from tidemark.operators.lookup import valence_lookup
    shocks = valence_lookup(T.topic_news(spark, sf_dir), "topic", EVENT_VALENCE).filter(F.col("valence") != 0)
    sc = windows.weekly_sign_counts(shocks, "publishedAt", "valence")
    price = windows.weekly_mean(T.energy_hourly(spark, sf_dir), "ts", ["spot"]).withColumnRenamed("spot", "price")
    return round_doubles(sc.join(price, "week", "inner").select("week", "positive_count", "negative_count", "price"))
