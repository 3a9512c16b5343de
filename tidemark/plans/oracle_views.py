"""DuckDB definitions of the substitute views (twins of ``sources.tables``).

They are prepended as CTEs to each oracle query, so the oracle reads only the
driver's pre-registered tables.  Every definition is written independently of the
Spark code path and computes the same relation.
"""

from __future__ import annotations

V_ENERGY_H = """
v_energy_h AS (
  WITH b AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events),
  sp AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b),
  hr AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS spot_raw, sum(value) AS load_raw
         FROM events GROUP BY 1),
  j AS (SELECT 'events' AS series_id, sp.ts AS ts, coalesce(hr.spot_raw, 0.0) AS spot,
               coalesce(hr.load_raw, 0.0) AS load
        FROM sp LEFT JOIN hr ON sp.ts = hr.ts)
  SELECT series_id, ts, spot,
         avg(spot) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS da,
         load
  FROM j
)"""

V_ENERGY_D = """
v_energy_d AS (
  SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts,
         avg(l_extendedprice / nullif(l_quantity, 0)) AS spot,
         1.05 * avg(l_extendedprice * (1 - l_discount) / nullif(l_quantity, 0)) AS da,
         sum(l_quantity) AS load
  FROM lineitem GROUP BY 1, 2
)"""

V_TOPIC_NEWS = """
v_topic_news AS (
  SELECT event_id AS article_id, ts AS publishedAt, event_type AS topic, value AS score FROM events
)"""

V_NEWS = """
v_news AS (
  SELECT doc_id AS article_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 7919) % 43200 AS BIGINT)) AS publishedAt,
         text AS title, text AS description, source,
         'http://example.com/' || CAST(doc_id AS VARCHAR) AS url
  FROM documents
)"""

V_EMBEDDED = """
v_embedded AS (
  SELECT vec_id AS article_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((vec_id * 7919) % 43200 AS BIGINT)) AS publishedAt,
         CAST(label AS VARCHAR) AS topic, embedding
  FROM embeddings
)"""

V_PRED = """
v_pred AS (
  WITH b AS (
    SELECT o_orderkey AS row_id,
           CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS BIGINT) AS y_true
    FROM orders),
  r AS (
    SELECT row_id, y_true,
           CAST(1 + (row_id * 3) % 97 + CASE WHEN y_true = 0 THEN 40 ELSE 0 END AS DOUBLE) AS r0,
           CAST(1 + (row_id * 4) % 97 + CASE WHEN y_true = 1 THEN 40 ELSE 0 END AS DOUBLE) AS r1,
           CAST(1 + (row_id * 5) % 97 + CASE WHEN y_true = 2 THEN 40 ELSE 0 END AS DOUBLE) AS r2
    FROM b)
  SELECT 'signal' AS model, row_id, y_true,
         CAST(CASE WHEN row_id % 10 < 6 THEN y_true ELSE (y_true + 1) % 3 END AS BIGINT) AS y_pred,
         r0 / (r0 + r1 + r2) AS p0, r1 / (r0 + r1 + r2) AS p1, r2 / (r0 + r1 + r2) AS p2
  FROM r
  UNION ALL
  SELECT 'baseline' AS model, row_id, y_true,
         CAST(CASE WHEN row_id % 7 < 4 THEN y_true ELSE (y_true + 2) % 3 END AS BIGINT) AS y_pred,
         r0 / (r0 + r1 + r2) AS p0, r1 / (r0 + r1 + r2) AS p1, r2 / (r0 + r1 + r2) AS p2
  FROM r
)"""

# Master table over an energy view (deadband 3.0, horizon 24, week 168), as plans.ingest.
def master_cte(name: str, src: str) -> str:
    return f"""
{name} AS (
  WITH e AS (
    SELECT series_id, ts, spot, da, load, spot - da AS real_spread_abs,
           CAST(CASE WHEN abs(spot - da) <= 3.0 THEN 0 ELSE sign(spot - da) END AS BIGINT) AS spread_target
    FROM {src}
    WHERE series_id IS NOT NULL AND ts IS NOT NULL AND spot IS NOT NULL AND NOT isnan(spot)
      AND da IS NOT NULL AND NOT isnan(da) AND load IS NOT NULL AND NOT isnan(load)),
  s AS (
    SELECT *,
      lead(real_spread_abs, 24) OVER w AS real_spread_abs_shift_24,
      lead(spread_target, 24) OVER w AS spread_target_shift_24,
      lag(spot, 24) OVER w AS price_lag_24,
      lag(spot, 168) OVER w AS price_lag_168,
      lag(load, 24) OVER w AS load_lag_24,
      lag(load, 168) OVER w AS load_lag_168
    FROM e WINDOW w AS (PARTITION BY series_id ORDER BY ts))
  SELECT *, CAST(hour(ts) AS BIGINT) AS hour, CAST(weekofyear(ts) AS BIGINT) AS week_of_year,
         CAST(month(ts) AS BIGINT) AS month, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
         CAST(dayofyear(ts) AS BIGINT) AS day_of_year
  FROM s
  WHERE real_spread_abs_shift_24 IS NOT NULL AND spread_target_shift_24 IS NOT NULL
    AND price_lag_24 IS NOT NULL AND price_lag_168 IS NOT NULL
    AND load_lag_24 IS NOT NULL AND load_lag_168 IS NOT NULL
)"""


V_MASTER_H = master_cte("v_master_h", "v_energy_h")
V_MASTER_D = master_cte("v_master_d", "v_energy_d")

V_ACTIONS = """
v_actions AS (
  WITH m AS (
    SELECT series_id, ts, spot, da, real_spread_abs, real_spread_abs_shift_24,
           CAST(coalesce(sign(lag(real_spread_abs, 1) OVER w), 0) AS BIGINT) AS a_signal,
           CAST((row_number() OVER w) % 3 - 1 AS BIGINT) AS a_baseline
    FROM v_master_h WINDOW w AS (PARTITION BY series_id ORDER BY ts))
  SELECT 'long' AS strategy, series_id, ts, spot, da, real_spread_abs, real_spread_abs_shift_24,
         CAST(1 AS BIGINT) AS action FROM m
  UNION ALL
  SELECT 'signal', series_id, ts, spot, da, real_spread_abs, real_spread_abs_shift_24, a_signal FROM m
  UNION ALL
  SELECT 'baseline', series_id, ts, spot, da, real_spread_abs, real_spread_abs_shift_24, a_baseline FROM m
)"""

_DEPS = {
    "v_energy_h": (V_ENERGY_H, []),
    "v_energy_d": (V_ENERGY_D, []),
    "v_topic_news": (V_TOPIC_NEWS, []),
    "v_news": (V_NEWS, []),
    "v_embedded": (V_EMBEDDED, []),
    "v_pred": (V_PRED, []),
    "v_master_h": (V_MASTER_H, ["v_energy_h"]),
    "v_master_d": (V_MASTER_D, ["v_energy_d"]),
    "v_actions": (V_ACTIONS, ["v_master_h"]),
}


def with_views(body: str, *views: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the named views (and their dependencies) as CTEs."""
    order: list[str] = []

    def visit(v: str) -> None:
        for d in _DEPS[v][1]:
            visit(d)
        if v not in order:
            order.append(v)

    for v in views:
        visit(v)
    parts = [_DEPS[v][0].strip() for v in order] + [e.strip() for e in (extra or [])]
    body = body.strip()
    if body[:5].upper() == "WITH " and parts:
        # merge the body's own CTE list into ours
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


def rounded(select_sql: str, cols: list[str], digits: int = 6) -> str:
    """Wrap a SELECT so the listed double columns are rounded like the Spark side."""
    if not cols:
        return select_sql
    rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{select_sql.strip()}\n) _q"


def clean_text_sql(x: str) -> str:
    """DuckDB twin of functions.text.clean_news_text (RE2; data has only ASCII spaces)."""
    c = f"replace({x}, '\"', '')"
    c = f"regexp_replace({c}, '\\*{{3,}}.*?\\*{{3,}}\\s*', '', 'g')"
    c = f"regexp_replace({c}, '^\\*+\\s*|\\s*\\*+$', '', 'g')"
    c = f"regexp_replace({c}, '\\s+', ' ', 'g')"
    return f"trim({c})"
