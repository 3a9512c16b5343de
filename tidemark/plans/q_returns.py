"""Registered queries: returns, summaries, backtest and cost sensitivity (P20-P22,
P25, A11-A13, A30, A31, B1-B3, J6, J10, W3, W4, W14, R7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import returns as rt
from tidemark.plans.common import round_doubles
from tidemark.plans.oracle_views import rounded, with_views
from tidemark.plans.registry import register
from tidemark.sources import tables as T

COST = 0.06
PCT_COST = 0.001
# Cost scenarios of the sensitivity table (reference default and notebook value).
COST_SCENARIOS = [0.0, 0.06, 0.5]


def _actions(spark, sf_dir):
    return T.actions(spark, sf_dir).withColumnRenamed("real_spread_abs_shift_24", "spread")


_RET_SQL = f"""
rets AS (SELECT strategy, series_id, ts, action, real_spread_abs_shift_24 AS spread,
                CASE WHEN action = 1 THEN real_spread_abs_shift_24
                     WHEN action = -1 THEN -real_spread_abs_shift_24 ELSE 0.0 END
                - CASE WHEN action <> 0 THEN {COST} ELSE 0.0 END
                - CASE WHEN action <> 0 THEN abs(real_spread_abs_shift_24) * {PCT_COST} ELSE 0.0 END AS ret
         FROM v_actions)"""


@register("p20_strategy_returns", with_views(rounded("SELECT strategy, series_id, ts, action, ret FROM rets",
                                                     ["ret"]), "v_actions", extra=[_RET_SQL]))
def p20_strategy_returns(spark, sf_dir):
    r = rt.action_returns(_actions(spark, sf_dir), cost=COST, pct_cost=PCT_COST)
    return round_doubles(r.select("strategy", "series_id", "ts", "action", "ret"))


@register("a11_spread_normalizer", with_views(rounded("""
SELECT series_id, avg(abs(real_spread_abs_shift_24)) AS normalizer FROM v_master_h GROUP BY series_id
""", ["normalizer"]), "v_master_h"))
def a11_spread_normalizer(spark, sf_dir):
    from tidemark.plans.ingest import master_table
    m = master_table(T.energy_hourly(spark, sf_dir))
    return round_doubles(rt.spread_normalizer(m, "real_spread_abs_shift_24", ["series_id"]))


@register("a12_return_summary", with_views(rounded(f"""
WITH nz AS (SELECT series_id, avg(abs(spread)) AS norm FROM rets WHERE strategy = 'long' GROUP BY 1),
d AS (SELECT r.*, nz.norm,
             sum(ret) OVER (PARTITION BY strategy, series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum
      FROM rets r JOIN nz USING (series_id)),
d2 AS (SELECT *, cum - max(cum) OVER (PARTITION BY strategy, series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM d),
g AS (SELECT strategy, series_id, sum(ret) AS tot, avg(ret) AS mean, stddev_samp(ret) AS sd,
             stddev_samp(ret) FILTER (WHERE ret < 0) AS dsd, count(*) FILTER (WHERE ret < 0) AS nneg,
             min(dd) AS mdd, count(*) FILTER (WHERE ret <> 0) AS n_trades,
             count(*) FILTER (WHERE ret > 0) AS nwin, first(norm) AS norm
      FROM d2 GROUP BY strategy, series_id)
SELECT strategy, series_id, tot * (100.0 / norm) AS total_return, mean * (100.0 / norm) AS avg_return,
       sd * (100.0 / norm) AS volatility,
       CASE WHEN sd > 0 THEN mean / sd * {rt.PERIODS_PER_YEAR ** 0.5!r} END AS sharpe,
       CASE WHEN nneg > 1 AND dsd > 0 THEN mean / dsd * {rt.PERIODS_PER_YEAR ** 0.5!r} END AS sortino,
       mdd * (100.0 / norm) AS max_drawdown,
       CASE WHEN n_trades > 0 THEN nwin / n_trades * 100 ELSE 0.0 END AS win_rate, n_trades
FROM g""", ["total_return", "avg_return", "volatility", "sharpe", "sortino", "max_drawdown", "win_rate"]),
    "v_actions", extra=[_RET_SQL]))
def a12_return_summary(spark, sf_dir):
    a = _actions(spark, sf_dir)
    r = rt.action_returns(a, cost=COST, pct_cost=PCT_COST)
    norm = rt.spread_normalizer(a.filter(F.col("strategy") == "long"), "spread", ["series_id"])
    r = r.join(norm, "series_id")          # one row per series: AQE broadcasts it
    return round_doubles(rt.summarise_returns(r, ["strategy", "series_id"], ["ts"], "ret", normalizer="normalizer"))


# Reference defaults of the cost study (name, fixed cost, share of the spread).
COST_STUDY = [("No Costs", 0.0, 0.0), ("Low Cost", 0.5, 0.0), ("Medium Cost", 1.0, 0.0), ("High Cost", 2.0, 0.001)]
COST_RANGE = [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0]


def _study() -> list[tuple[str, float, float]]:
    return COST_STUDY + [(f"Fixed {c}", c, 0.0) for c in COST_RANGE]


def _r7_sql() -> str:
    rows = ", ".join(f"('{n}', {c}::DOUBLE, {p}::DOUBLE)" for n, c, p in _study())
    rets = f"""
sc(scenario, fixed, pct) AS (VALUES {rows}),
rets AS (SELECT scenario, fixed AS fixed_cost, pct AS pct_cost, strategy, series_id, ts, real_spread_abs_shift_24 AS spread,
                CASE WHEN action = 1 THEN real_spread_abs_shift_24
                     WHEN action = -1 THEN -real_spread_abs_shift_24 ELSE 0.0 END
                - CASE WHEN action <> 0 THEN fixed ELSE 0.0 END
                - CASE WHEN action <> 0 THEN abs(real_spread_abs_shift_24) * pct ELSE 0.0 END AS ret
         FROM v_actions CROSS JOIN sc)"""
    part = "PARTITION BY scenario, strategy, series_id ORDER BY ts ROWS UNBOUNDED PRECEDING"
    sel = f"""
WITH nz AS (SELECT series_id, avg(abs(spread)) AS norm FROM rets WHERE strategy = 'long' GROUP BY 1),
d AS (SELECT r.*, nz.norm, sum(ret) OVER ({part}) AS cum FROM rets r JOIN nz USING (series_id)),
d2 AS (SELECT *, cum - max(cum) OVER ({part}) AS dd FROM d),
g AS (SELECT scenario, fixed_cost, pct_cost, strategy, series_id, sum(ret) AS tot, avg(ret) AS mean, stddev_samp(ret) AS sd,
             stddev_samp(ret) FILTER (WHERE ret < 0) AS dsd, count(*) FILTER (WHERE ret < 0) AS nneg,
             min(dd) AS mdd, count(*) FILTER (WHERE ret <> 0) AS n_trades,
             count(*) FILTER (WHERE ret > 0) AS nwin, first(norm) AS norm FROM d2 GROUP BY ALL)
SELECT scenario, fixed_cost, pct_cost, strategy, series_id, tot * (100.0 / norm) AS total_return,
       mean * (100.0 / norm) AS avg_return, sd * (100.0 / norm) AS volatility,
       CASE WHEN sd > 0 THEN mean / sd * {rt.PERIODS_PER_YEAR ** 0.5!r} END AS sharpe,
       CASE WHEN nneg > 1 AND dsd > 0 THEN mean / dsd * {rt.PERIODS_PER_YEAR ** 0.5!r} END AS sortino,
       mdd * (100.0 / norm) AS max_drawdown,
       CASE WHEN n_trades > 0 THEN nwin / n_trades * 100 ELSE 0.0 END AS win_rate, n_trades
FROM g"""
    return with_views(rounded(sel, ["total_return", "avg_return", "volatility", "sharpe", "sortino", "max_drawdown",
                                    "win_rate"]), "v_actions", extra=[rets])


@register("r7_cost_sensitivity", _r7_sql())
def r7_cost_sensitivity(spark, sf_dir):
    a = _actions(spark, sf_dir)
    norm = rt.spread_normalizer(a.filter(F.col("strategy") == "long"), "spread", ["series_id"])
    scenarios = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(c).alias("fixed_cost"), F.lit(p).alias("pct_cost"))
                                    for n, c, p in _study()]))
    each = a.withColumn("_s", scenarios).select("*", "_s.*").drop("_s")
    r = rt.action_returns(each, cost="fixed_cost", pct_cost="pct_cost").join(norm, "series_id")
    keys = ["scenario", "fixed_cost", "pct_cost", "strategy", "series_id"]
    return round_doubles(rt.summarise_returns(r, keys, ["ts"], "ret", normalizer="normalizer"))


@register("w3_cumulative_drawdown", with_views(rounded("""
WITH d AS (SELECT strategy, series_id, ts, ret,
                  sum(ret) OVER (PARTITION BY strategy, series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM rets),
d2 AS (SELECT *, max(equity) OVER (PARTITION BY strategy, series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS running_max FROM d)
SELECT strategy, series_id, ts, equity, running_max, equity - running_max AS drawdown,
       (equity - running_max) / nullif(running_max, 0.0) * 100 AS drawdown_pct FROM d2
""", ["equity", "running_max", "drawdown", "drawdown_pct"]), "v_actions", extra=[_RET_SQL]))
def w3_cumulative_drawdown(spark, sf_dir):
    r = rt.action_returns(_actions(spark, sf_dir), cost=COST, pct_cost=PCT_COST)
    from tidemark.plans.scan import running_drawdown
    d = running_drawdown(r.select("strategy", "series_id", "ts", "ret"), ["strategy", "series_id"], ["ts"], "ret")
    return round_doubles(d.select("strategy", "series_id", "ts", "equity", "running_max", "drawdown", "drawdown_pct"))


# ---------------------------------------------------------------- backtest twin


def _step_sql(v: str, p: str = "") -> dict[str, str]:
    """SQL expressions of one fold step from state ``v`` over the row columns
    ``{p}da, {p}s, {p}a, {p}cost`` (same operation order as backtest.portfolio_backtest)."""
    da, sp, a, cost = f"{p}da", f"{p}s", f"{p}a", f"{p}cost"
    pos = f"({v} * {bt.POSITION_PCT!r})"
    sizing = f"greatest(abs({da}), {bt.PRICE_FLOOR!r})"
    mwh = f"least(CASE WHEN {v} > 0 THEN {pos} / {sizing} ELSE 0.0 END, {bt.MAX_MWH_PER_TRADE!r})"
    g_unc = f"({mwh} * {sp} * {a})"
    m = f"({pos} * {bt.MAX_POSITION_RETURN_PCT!r})"
    g = f"least(greatest({g_unc}, -{m}), {m})"
    tc = f"({mwh} * {cost})"
    net = f"({g} - {tc})"
    skip = f"({sp} IS NULL OR isnan({sp}) OR {a} = 0)"
    after = f"(CASE WHEN {skip} THEN {v} ELSE greatest({v} + {net}, 0.0) END)"
    return {"pos": pos, "mwh": mwh, "g_unc": g_unc, "g": g, "tc": tc, "net": net, "after": after, "skip": skip}


def _backtest_sql(cost_values: list[float] | None = None) -> tuple[str, str]:
    """(CTE text, body) computing the trade log as a recursive CTE in DuckDB."""
    if cost_values is None:
        costs = f"SELECT {COST}::DOUBLE AS cost"
    else:
        costs = "SELECT * FROM (VALUES " + ", ".join(f"({c}::DOUBLE)" for c in cost_values) + ") c(cost)"
    st0 = _step_sql(f"CAST({bt.INITIAL_CAPITAL!r} AS DOUBLE)")
    st1 = _step_sql("r.v_after", "b.")
    cte = f"""
costs AS ({costs}),
base AS (SELECT v.strategy, v.series_id, c.cost, v.ts,
                CAST(row_number() OVER (PARTITION BY v.strategy, v.series_id, c.cost ORDER BY v.ts) - 1 AS BIGINT) AS period,
                v.action AS a, v.spot, v.da, v.real_spread_abs_shift_24 AS s
         FROM v_actions v CROSS JOIN costs c),
fold AS (
  SELECT strategy, series_id, cost, period, CAST({bt.INITIAL_CAPITAL!r} AS DOUBLE) AS v_before,
         CAST({st0['after']} AS DOUBLE) AS v_after
  FROM base WHERE period = 0
  UNION ALL
  SELECT b.strategy, b.series_id, b.cost, b.period, r.v_after, {st1['after']}
  FROM fold r JOIN base b ON b.strategy = r.strategy AND b.series_id = r.series_id AND b.cost = r.cost
                          AND b.period = r.period + 1),
log AS (
  SELECT b.strategy, b.series_id, b.cost, b.ts, b.period, b.a, b.spot, b.da, b.s, f.v_before, f.v_after
  FROM base b JOIN fold f USING (strategy, series_id, cost, period))"""
    v = "v_before"
    x = _step_sql(v)
    traded = "(NOT (s IS NULL OR isnan(s)) AND a <> 0)"
    body = f"""
SELECT strategy, series_id, cost, ts, period,
       CAST(CASE WHEN {traded} THEN a ELSE 0 END AS BIGINT) AS action,
       spot AS spot_price, da AS day_ahead_price, CASE WHEN isnan(s) THEN NULL ELSE s END AS spread,
       CASE WHEN {traded} THEN {x['pos']} ELSE 0.0 END AS position_value,
       CASE WHEN {traded} THEN {x['mwh']} ELSE 0.0 END AS mwh_traded,
       CASE WHEN {traded} THEN {x['g_unc']} END AS gross_pnl_uncapped,
       CASE WHEN {traded} THEN {x['g']} ELSE 0.0 END AS gross_pnl,
       CASE WHEN {traded} THEN {x['g']} <> {x['g_unc']} END AS pnl_was_capped,
       CASE WHEN {traded} THEN cost END AS cost_per_mwh,
       CASE WHEN {traded} THEN {x['tc']} ELSE 0.0 END AS fixed_cost,
       0.0 AS pct_cost,
       CASE WHEN {traded} THEN {x['tc']} ELSE 0.0 END AS total_cost,
       CASE WHEN {traded} THEN {x['net']} ELSE 0.0 END AS net_pnl,
       v_after AS portfolio_value, v_before AS equity,
       CASE WHEN period = 0 THEN 0.0 ELSE (v_after - v_before) / nullif(v_before, 0.0) * 100 END AS return_pct
FROM log"""
    return cte, body


_LOG_DOUBLES = ["spot_price", "day_ahead_price", "spread", "position_value", "mwh_traded", "gross_pnl_uncapped",
                "gross_pnl", "cost_per_mwh", "fixed_cost", "pct_cost", "total_cost", "net_pnl",
                "portfolio_value", "equity", "return_pct"]


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql[len("WITH "):]


def _b1_sql() -> str:
    cte, body = _backtest_sql()
    return _recursive(with_views(rounded(body.replace("SELECT strategy, series_id, cost, ts",
                                                      "SELECT strategy, series_id, ts"), _LOG_DOUBLES),
                                 "v_actions", extra=[cte]))


def _trade_log(spark, sf_dir, costs: list[float] | None = None):
    a = T.actions(spark, sf_dir)
    if costs is None:
        return bt.portfolio_backtest(a, ["strategy", "series_id"], cost=COST)
    a = a.select("*", F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost"))
    return bt.portfolio_backtest(a, ["strategy", "series_id", "cost"], cost="cost")


@register("b1_portfolio_backtest", _b1_sql())
def b1_portfolio_backtest(spark, sf_dir):
    return round_doubles(_trade_log(spark, sf_dir))


_METRICS_SQL = f"""
m0 AS (SELECT *, max(equity) OVER (PARTITION BY strategy, series_id, cost ORDER BY period ROWS UNBOUNDED PRECEDING) AS rmax
       FROM tl),
g AS (SELECT strategy, series_id, cost, arg_max(equity, period) AS final_value, count(*) AS n_periods,
             stddev_samp(return_pct) FILTER (WHERE return_pct <> 0) AS sd,
             count(return_pct) FILTER (WHERE return_pct <> 0) AS nnz,
             stddev_samp(return_pct) FILTER (WHERE return_pct < 0) AS dsd,
             count(*) FILTER (WHERE return_pct < 0) AS nneg,
             min(equity - rmax) AS mdd, max(rmax) AS gmax,
             count(*) FILTER (WHERE action <> 0) AS total_trades,
             count(*) FILTER (WHERE action <> 0 AND net_pnl > 0) AS wins,
             count(*) FILTER (WHERE pnl_was_capped) AS trades_capped, sum(total_cost) AS total_costs
      FROM m0 GROUP BY ALL),
h AS (SELECT *, (final_value - {bt.INITIAL_CAPITAL!r}) / {bt.INITIAL_CAPITAL!r} * 100 AS total_return_pct,
             n_periods / {float(bt.PERIODS_PER_YEAR)!r} AS years FROM g),
k AS (SELECT *, CASE WHEN years >= 0.01 THEN (pow(final_value / {bt.INITIAL_CAPITAL!r}, 1 / years) - 1) * 100
                     ELSE total_return_pct END AS annualized_return_pct,
             CASE WHEN nnz > 0 THEN sd * {bt.PERIODS_PER_YEAR ** 0.5!r} END AS volatility,
             CASE WHEN nnz > 0 AND nneg > 1 THEN dsd * {bt.PERIODS_PER_YEAR ** 0.5!r} END AS dvol FROM h)"""

_METRICS_SELECT = """
SELECT strategy, series_id, {cost}final_value, total_return_pct, annualized_return_pct, volatility,
       CASE WHEN volatility > 0 THEN annualized_return_pct / volatility END AS sharpe,
       CASE WHEN dvol > 0 THEN annualized_return_pct / dvol END AS sortino,
       CASE WHEN gmax > 0 THEN mdd / gmax * 100 ELSE 0.0 END AS max_drawdown_pct,
       CASE WHEN total_trades > 0 THEN wins / total_trades * 100 ELSE 0.0 END AS win_rate,
       total_trades, trades_capped, total_costs
FROM k"""

_METRIC_DOUBLES = ["final_value", "total_return_pct", "annualized_return_pct", "volatility", "sharpe", "sortino",
                   "max_drawdown_pct", "win_rate", "total_costs"]


def _metrics_sql(costs: list[float] | None) -> str:
    cte, body = _backtest_sql(costs)
    tl = f"tl AS ({body.strip()})"
    sel = _METRICS_SELECT.format(cost="cost, " if costs else "")
    return _recursive(with_views(rounded(sel, _METRIC_DOUBLES), "v_actions", extra=[cte, tl, _METRICS_SQL]))


@register("a30_backtest_metrics", _metrics_sql(None))
def a30_backtest_metrics(spark, sf_dir):
    return round_doubles(bt.backtest_metrics(_trade_log(spark, sf_dir)))


@register("b2_backtest_cost_scenarios", _metrics_sql(COST_SCENARIOS))
def b2_backtest_cost_scenarios(spark, sf_dir):
    log = _trade_log(spark, sf_dir, COST_SCENARIOS)
    return round_doubles(bt.backtest_metrics(log, ["strategy", "series_id", "cost"]))


def _tail_sql() -> str:
    cte, body = _backtest_sql()
    tl = f"tl AS ({body.strip()})"
    sel = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY strategy, series_id ORDER BY period DESC) AS p FROM tl)
SELECT strategy, series_id, count(*) AS n_periods, min(period) AS first_period, max(period) AS last_period,
       arg_max(equity, p) AS start_equity, arg_min(equity, p) AS end_value,
       arg_min(equity, p) - arg_max(equity, p) AS total_pnl,
       (arg_min(equity, p) - arg_max(equity, p)) / arg_max(equity, p) * 100 AS total_pnl_pct,
       count(*) FILTER (WHERE action <> 0) AS n_trades,
       count(*) FILTER (WHERE action <> 0 AND net_pnl > 0) AS n_wins,
       count(*) FILTER (WHERE action <> 0 AND net_pnl < 0) AS n_losses,
       count(*) FILTER (WHERE action <> 0 AND net_pnl > 0) / nullif(count(*) FILTER (WHERE action <> 0), 0) * 100 AS win_rate,
       avg(spread) AS spread_mean, stddev_samp(spread) AS spread_std, min(spread) AS spread_min,
       max(spread) AS spread_max, count(*) FILTER (WHERE action = 1) AS n_long,
       count(*) FILTER (WHERE action = -1) AS n_short, count(*) FILTER (WHERE action = 0) AS n_flat,
       sum(CASE WHEN action = 1 THEN net_pnl ELSE 0.0 END) AS pnl_long,
       sum(CASE WHEN action = -1 THEN net_pnl ELSE 0.0 END) AS pnl_short
FROM t WHERE p <= 20 GROUP BY ALL"""
    return _recursive(with_views(rounded(sel, ["start_equity", "end_value", "total_pnl", "total_pnl_pct", "win_rate", "spread_mean", "spread_std",
                                               "spread_min", "spread_max", "pnl_long", "pnl_short"]),
                                 "v_actions", extra=[cte, tl]))


@register("a31_equity_tail_report", _tail_sql())
def a31_equity_tail_report(spark, sf_dir):
    return round_doubles(bt.equity_tail_report(_trade_log(spark, sf_dir), 20))


def _losses_sql() -> str:
    cte, body = _backtest_sql()
    tl = f"tl AS ({body.strip()})"
    sel = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY strategy, series_id ORDER BY period DESC) AS p FROM tl),
l AS (SELECT *, row_number() OVER (PARTITION BY strategy, series_id ORDER BY net_pnl, period) AS rank
      FROM t WHERE p <= 20 AND action <> 0 AND net_pnl < 0)
SELECT strategy, series_id, rank, period, action, spread, net_pnl FROM l WHERE rank <= 5"""
    return _recursive(with_views(rounded(sel, ["spread", "net_pnl"]), "v_actions", extra=[cte, tl]))


@register("k5_largest_losses", _losses_sql())
def k5_largest_losses(spark, sf_dir):
    return round_doubles(bt.largest_losses(_trade_log(spark, sf_dir), 20, 5))


def _equity_sql() -> str:
    cte, body = _backtest_sql()
    tl = f"tl AS ({body.strip()})"
    sel = """
WITH d AS (SELECT strategy, series_id, ts, period, equity, (equity / 100000.0 - 1) * 100 AS return_pct_total,
                  max(equity) OVER (PARTITION BY strategy, series_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS running_max
           FROM tl)
SELECT *, equity - running_max AS drawdown, (equity - running_max) / nullif(running_max, 0.0) * 100 AS drawdown_pct
FROM d"""
    return _recursive(with_views(rounded(sel, ["equity", "return_pct_total", "running_max", "drawdown",
                                               "drawdown_pct"]), "v_actions", extra=[cte, tl]))


@register("b3_equity_drawdown", _equity_sql())
def b3_equity_drawdown(spark, sf_dir):
    return round_doubles(bt.equity_report(_trade_log(spark, sf_dir)))
