"""Registered queries: decayed look-back aggregation (A1-A3, J1, J2, M1 inputs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import decay
from tidemark.plans.ingest import master_table
from tidemark.plans.oracle_views import with_views
from tidemark.plans.registry import register
from tidemark.sources import tables as T

HOURS_US = 3600000000


def _master(spark, sf_dir):
    return master_table(T.energy_hourly(spark, sf_dir))


_A1_SQL = with_views(f"""
SELECT m.ts AS ts, a.topic AS topic,
       round(sum(exp(-0.05 * ((epoch_us(m.ts) - epoch_us(a.publishedAt)) // {HOURS_US}))), 6) AS weight
FROM (SELECT DISTINCT ts FROM v_master_h) m
JOIN v_topic_news a ON a.publishedAt <= m.ts AND a.publishedAt >= m.ts - INTERVAL 336 HOUR
WHERE a.topic IS NOT NULL AND a.topic <> 'error'
GROUP BY 1, 2
""", "v_master_h", "v_topic_news")


_A1Q_SQL = with_views(f"""
SELECT m.ts AS ts, a.topic AS topic,
       round(sum(exp(-0.05 * ((epoch_us(m.ts) - epoch_us(a.publishedAt)) // {HOURS_US}))), 6) AS weight
FROM (SELECT DISTINCT ts + o.m * INTERVAL 1 MINUTE AS ts FROM v_master_h, (VALUES (0), (15), (30), (45)) o(m)) m
JOIN v_topic_news a ON a.publishedAt <= m.ts AND a.publishedAt >= m.ts - INTERVAL 48 HOUR
WHERE a.topic IS NOT NULL AND a.topic <> 'error'
GROUP BY 1, 2
""", "v_master_h", "v_topic_news")


@register("a1_decayed_counts_quarter_hours", _A1Q_SQL)
def a1_decayed_counts_quarter_hours(spark, sf_dir):
    """A1 for targets that are not on the hour."""
    quarters = F.explode(F.array(*[F.expr(f"INTERVAL {m} MINUTES") for m in (0, 15, 30, 45)]))
    targets = _master(spark, sf_dir).select("ts").distinct().select("ts", quarters.alias("q"))
    targets = targets.select((F.col("ts") + F.col("q")).cast("timestamp_ntz").alias("ts"))
    out = decay.decayed_topic_counts(T.topic_news(spark, sf_dir), targets, 48, 0.05,
                                     other_label=T.OTHER_TOPIC_EVENTS, any_instant=True)
    return out.select("ts", "topic", F.round("weight", 6).alias("weight"))


@register("a1_decayed_topic_counts", _A1_SQL)
def a1_decayed_topic_counts(spark, sf_dir):
    out = decay.decayed_topic_counts(T.topic_news(spark, sf_dir), _master(spark, sf_dir),
                                     336, 0.05, other_label=T.OTHER_TOPIC_EVENTS)
    return out.select("ts", "topic", F.round("weight", 6).alias("weight"))


def _a2_sql() -> str:
    body = f"""
u AS (
  SELECT publishedAt, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
  FROM v_embedded
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
),
pairs AS (
  SELECT m.ts AS ts, u.pos AS pos, u.v AS v,
         exp(-0.05 * ((epoch_us(m.ts) - epoch_us(u.publishedAt)) // {HOURS_US})) AS w
  FROM (SELECT DISTINCT ts FROM v_master_h) m
  JOIN u ON u.publishedAt <= m.ts AND u.publishedAt >= m.ts - INTERVAL 336 HOUR
)"""
    return with_views("""
SELECT ts, CAST(pos - 1 AS BIGINT) AS dim,
       round(CASE WHEN sum(w) > 1e-10 THEN sum(w * v) / sum(w) ELSE 0.0 END, 6) AS value
FROM pairs GROUP BY 1, 2
""", "v_master_h", "v_embedded", extra=[body])


@register("a2_decayed_embeddings", _a2_sql())
def a2_decayed_embeddings(spark, sf_dir):
    out = decay.decayed_embeddings(T.embedded_news(spark, sf_dir), _master(spark, sf_dir), 336, 0.05)
    return out.select("ts", "dim", F.round("value", 6).alias("value"))


def _params_sql() -> str:
    ls = ", ".join(f"({v})" for v in decay.LOOKBACK_WINDOWS)
    ds = ", ".join(f"({v}::DOUBLE)" for v in decay.TIME_DECAY_LAMBDAS)
    return (f"params AS (SELECT CAST(l AS BIGINT) AS lookback, d AS decay_lambda "
            f"FROM (VALUES {ls}) lv(l) CROSS JOIN (VALUES {ds}) dv(d))")


def _a3_sql() -> str:
    lmax = max(decay.LOOKBACK_WINDOWS)
    pairs = f"""
pairs AS (
  SELECT m.ts AS ts, a.topic AS topic, epoch_us(m.ts) - epoch_us(a.publishedAt) AS age_us
  FROM (SELECT DISTINCT ts FROM v_master_h) m
  JOIN v_topic_news a ON a.publishedAt <= m.ts AND a.publishedAt >= m.ts - INTERVAL {lmax} HOUR
  WHERE a.topic IS NOT NULL AND a.topic <> 'error'
)"""
    return with_views(f"""
SELECT p.lookback AS lookback, p.decay_lambda AS decay_lambda, x.ts AS ts, x.topic AS topic,
       round(sum(exp(-p.decay_lambda * (x.age_us // {HOURS_US}))), 6) AS weight
FROM pairs x JOIN params p ON x.age_us <= p.lookback * {HOURS_US}
GROUP BY 1, 2, 3, 4
""", "v_master_h", "v_topic_news", extra=[_params_sql(), pairs])


@register("a3_decay_grid_topics", _a3_sql())
def a3_decay_grid_topics(spark, sf_dir):
    out = decay.decayed_topic_grid(T.topic_news(spark, sf_dir), _master(spark, sf_dir),
                                   other_label=T.OTHER_TOPIC_EVENTS)
    return out.select("lookback", "decay_lambda", "ts", "topic", F.round("weight", 6).alias("weight"))


def _a3e_sql() -> str:
    lmax = max(decay.LOOKBACK_WINDOWS)
    body = f"""
u AS (
  SELECT publishedAt, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
  FROM v_embedded
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
),
pairs AS (
  SELECT m.ts AS ts, u.pos AS pos, u.v AS v, epoch_us(m.ts) - epoch_us(u.publishedAt) AS age_us
  FROM (SELECT DISTINCT ts FROM v_master_h) m
  JOIN u ON u.publishedAt <= m.ts AND u.publishedAt >= m.ts - INTERVAL {lmax} HOUR
)"""
    return with_views(f"""
SELECT lookback, decay_lambda, ts, CAST(pos - 1 AS BIGINT) AS dim,
       round(CASE WHEN sum(w) > 1e-10 THEN sum(w * v) / sum(w) ELSE 0.0 END, 6) AS value
FROM (SELECT p.lookback, p.decay_lambda, x.ts, x.pos, x.v,
             exp(-p.decay_lambda * (x.age_us // {HOURS_US})) AS w
      FROM pairs x JOIN params p ON x.age_us <= p.lookback * {HOURS_US})
GROUP BY 1, 2, 3, 4
""", "v_master_h", "v_embedded", extra=[body, _params_sql()])


@register("a3_decay_grid_embeddings", _a3e_sql())
def a3_decay_grid_embeddings(spark, sf_dir):
    out = decay.decayed_embedding_grid(T.embedded_news(spark, sf_dir), _master(spark, sf_dir))
    return out.select("lookback", "decay_lambda", "ts", "dim", F.round("value", 6).alias("value"))
