"""Strategy returns and their summary.

All strategies live in one long table (strategy, series_id, ts, action, spread):
returns are a projection, the summary is one window pass (running max for the
drawdown) plus one grouped aggregate keyed by strategy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIODS_PER_YEAR = 24 * 365


def action_returns(df: DataFrame, action: str = "action", spread: str = "spread",
                   cost: float | str = 0.0, pct_cost: float | str = 0.0, out: str = "ret") -> DataFrame:
    """+spread for long, -spread for short, 0 otherwise; minus a fixed cost
    and ``abs(spread) * pct_cost`` on every non-zero action.  Either cost is a number or
    the name of a column (a table of scenarios crossed with the rows, J6)."""
    a, s = F.col(action), F.col(spread)
    fixed, share = (F.col(c) if isinstance(c, str) else F.lit(float(c)) for c in (cost, pct_cost))
    gain = F.when(a == 1, s).when(a == -1, -s).otherwise(F.lit(0.0))
    paid = [F.when(a != 0, x).otherwise(F.lit(0.0)) for x in (fixed, F.abs(s) * share)]
    return df.withColumn(out, gain - paid[0] - paid[1])


def spread_normalizer(df: DataFrame, spread: str = "spread", keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute spread (raises at run time when it is 0)."""
    m = F.avg(F.abs(spread))
    return df.groupBy(*keys).agg(
        F.when(m == 0, F.raise_error(F.lit("Mean absolute spread is zero; cannot normalize to percentage.")))
         .otherwise(m).alias("normalizer"))


def summarise_returns(df: DataFrame, keys: Sequence[str] = ("strategy",), order: Sequence[str] = ("ts",),
                      ret: str = "ret", normalizer: str | None = None,
                      periods_per_year: int = PERIODS_PER_YEAR) -> DataFrame:
    """Total, mean, sample std, annualised Sharpe and Sortino, max drawdown,
    win rate over non-zero returns and trade count, per key group.

    With ``normalizer`` (a column holding the mean absolute spread) the money
    figures are scaled to percent of it ('percentage' mode)."""
    from tidemark.plans.scan import running_drawdown
    keys = list(keys)
    d = running_drawdown(df, keys, order, ret).withColumnRenamed("drawdown", "_dd")
    r = F.col(ret)
    aggs = [F.sum(r).alias("_tot"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"),
            F.stddev_samp(F.when(r < 0, r)).alias("_dstd"), F.count_if(r < 0).alias("_nneg"),
            F.min("_dd").alias("_mdd"), F.count_if(r != 0).alias("n_trades"), F.count_if(r > 0).alias("_nwin")]
    if normalizer:
        aggs.append(F.first(normalizer).alias("_norm"))
    g = d.groupBy(*keys).agg(*aggs)
    scale = (F.lit(100.0) / F.col("_norm")) if normalizer else F.lit(1.0)
    sq = math.sqrt(periods_per_year)
    return g.select(
        *keys,
        (F.col("_tot") * scale).alias("total_return"),
        (F.col("_mean") * scale).alias("avg_return"),
        (F.col("_std") * scale).alias("volatility"),
        F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * sq).alias("sharpe"),
        F.when((F.col("_nneg") > 1) & (F.col("_dstd") > 0), F.col("_mean") / F.col("_dstd") * sq).alias("sortino"),
        (F.col("_mdd") * scale).alias("max_drawdown"),
        F.when(F.col("n_trades") > 0, F.col("_nwin") / F.col("n_trades") * 100).otherwise(F.lit(0.0)).alias("win_rate"),
        F.col("n_trades"))
