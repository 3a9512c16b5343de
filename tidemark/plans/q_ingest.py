"""Registered queries: ingest stage (S*, P1-P8, P18, P29-P30, W1-W2, K1-K2, A34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.dedup import dedup_keep_earliest, seeded_sample
from tidemark.plans.common import round_doubles
from tidemark.plans.ingest import clean_news, lag_by_time, master_table
from tidemark.plans.oracle_views import clean_text_sql, rounded, with_views
from tidemark.plans.registry import register
from tidemark.sources import tables as T

MASTER_DOUBLES = ["spot", "da", "load", "real_spread_abs", "real_spread_abs_shift_24",
                  "price_lag_24", "price_lag_168", "load_lag_24", "load_lag_168"]
MIN_NEWS_TS = "2024-01-15 00:00:00"


@register("p1_clean_text", with_views(f"""
SELECT article_id, {clean_text_sql('title')} AS title, {clean_text_sql('description')} AS description
FROM v_news""", "v_news"))
def p1_clean_text(spark, sf_dir):
    return clean_news(T.news(spark, sf_dir)).select("article_id", "title", "description")


@register("p3_min_timestamp_filter", with_views(f"""
SELECT article_id, publishedAt FROM v_news WHERE publishedAt >= TIMESTAMP '{MIN_NEWS_TS}'
""", "v_news"))
def p3_min_timestamp_filter(spark, sf_dir):
    n = clean_news(T.news(spark, sf_dir), min_ts=MIN_NEWS_TS, clean_text=False)
    return n.select("article_id", "publishedAt")


@register("k2_dedup_title_earliest", with_views("""
SELECT article_id, publishedAt, title, description, source, url FROM v_news
QUALIFY row_number() OVER (PARTITION BY title ORDER BY publishedAt, article_id) = 1
""", "v_news"))
def k2_dedup_title_earliest(spark, sf_dir):
    return dedup_keep_earliest(T.news(spark, sf_dir), "title", ("publishedAt",), "article_id") \
        .select("article_id", "publishedAt", "title", "description", "source", "url")


@register("p18_seeded_sample", with_views("""
SELECT article_id, publishedAt, title FROM v_news
ORDER BY md5('42-' || CAST(article_id AS VARCHAR)), article_id LIMIT 400
""", "v_news"))
def p18_seeded_sample(spark, sf_dir):
    return seeded_sample(T.news(spark, sf_dir), 400, "article_id", 42) \
        .select("article_id", "publishedAt", "title")


_MASTER_COLS = ("series_id, ts, spot, da, load, real_spread_abs, spread_target, "
                "real_spread_abs_shift_24, spread_target_shift_24, price_lag_24, price_lag_168, "
                "load_lag_24, load_lag_168, hour, week_of_year, month, day_of_week, day_of_year")


@register("p30_master_hourly", with_views(rounded(f"SELECT {_MASTER_COLS} FROM v_master_h",
                                                  MASTER_DOUBLES), "v_master_h"))
def p30_master_hourly(spark, sf_dir):
    return round_doubles(master_table(T.energy_hourly(spark, sf_dir)))


@register("p30_master_daily_multiseries", with_views(rounded(f"SELECT {_MASTER_COLS} FROM v_master_d",
                                                             MASTER_DOUBLES), "v_master_d"))
def p30_master_daily_multiseries(spark, sf_dir):
    return round_doubles(master_table(T.energy_daily(spark, sf_dir)))


@register("w2_lag_by_time", with_views(rounded("""
SELECT a.series_id, a.ts, a.spot, a.load, b.spot AS spot_tlag_24, b.load AS load_tlag_24
FROM v_energy_d a LEFT JOIN v_energy_d b
  ON a.series_id = b.series_id AND a.ts = b.ts + INTERVAL 24 HOUR
""", ["spot", "load", "spot_tlag_24", "load_tlag_24"]), "v_energy_d"))
def w2_lag_by_time(spark, sf_dir):
    e = T.energy_daily(spark, sf_dir).select("series_id", "ts", "spot", "load")
    return round_doubles(lag_by_time(e, ["spot", "load"], 24))


@register("a34_source_stats", with_views("""
SELECT source, count(*) AS n_articles,
       count(DISTINCT source) OVER () AS n_sources,
       min(min(publishedAt)) OVER () AS first_published,
       max(max(publishedAt)) OVER () AS last_published
FROM v_news GROUP BY source
""", "v_news"))
def a34_source_stats(spark, sf_dir):
    """Articles per source plus corpus-wide unique sources and date range (the
    corpus-wide figures are one small aggregate, attached as literals)."""
    n = T.news(spark, sf_dir)
    per = n.groupBy("source").agg(F.count(F.lit(1)).alias("n_articles"))
    tot = n.agg(F.count_distinct("source").alias("u"), F.min("publishedAt").alias("lo"),
                F.max("publishedAt").alias("hi")).first()
    def ts_lit(v):   # wall-clock literal: no session/process time-zone conversion
        return F.lit(v.isoformat(sep=" ") if v is not None else None).cast("timestamp_ntz")
    return per.select("source", "n_articles", F.lit(int(tot["u"])).cast("bigint").alias("n_sources"),
                      ts_lit(tot["lo"]).alias("first_published"), ts_lit(tot["hi"]).alias("last_published"))
