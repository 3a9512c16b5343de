"""Window operators.

Every positional operator names its ordering column explicitly and partitions by a
key (``series_id``, ``strategy``, ``topic`` ...); see ``plans.scan`` for the
block-wise form used when one key holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.timecal import week_label


def _w(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def running_drawdown(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str],
                     cumulative: bool = True, prefix: str = "") -> DataFrame:
    """Running total (optional), running max, drawdown and drawdown %.

    ``cumulative=True``: equity = cumsum(value) (return series);
    ``cumulative=False``: equity = value (an equity curve).  The running frames are
    evaluated incrementally by Spark (one pass per partition)."""
    run = _w(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    eq = F.sum(value).over(run) if cumulative else F.col(value)
    out = df.withColumn(f"{prefix}equity", eq)
    out = out.withColumn(f"{prefix}running_max", F.max(f"{prefix}equity").over(run))
    out = out.withColumn(f"{prefix}drawdown", F.col(f"{prefix}equity") - F.col(f"{prefix}running_max"))
    return out.withColumn(
        f"{prefix}drawdown_pct",
        F.try_divide(F.col(f"{prefix}drawdown"), F.nullif(F.col(f"{prefix}running_max"), F.lit(0.0))) * 100)


def rolling_std(df: DataFrame, value: str, sizes: Sequence[int], keys: Sequence[str],
                order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Sample std over the last n rows, min_periods=1 (one row -> NULL).

    Evaluated range by range (``plans.scan.windowed``): a very long series is split over
    many tasks, and all sizes share one cut."""
    from tidemark.plans.scan import windowed
    return windowed(df, keys, order, max(int(n) for n in sizes) - 1, 0, {
        f"{value}_std_{n}": lambda w, n=int(n): F.stddev_samp(value).over(w.rowsBetween(-(n - 1), 0)) for n in sizes}, ranges)


def first_difference(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str],
                     out: str | None = None) -> DataFrame:
    """X - lag(x, 1)."""
    return df.withColumn(out or f"{value}_diff", F.col(value) - F.lag(value, 1).over(_w(keys, order)))


def rolling_pearson(df: DataFrame, x: str, y: str, window: int, keys: Sequence[str],
                    order: Sequence[str], out: str = "corr", min_pairs: int = 3) -> DataFrame:
    """Pearson r over the previous ``window`` rows (current row excluded), on
    pairs where both are non-NULL, NULL when fewer than ``min_pairs`` pairs, a
    constant side, or fewer than ``window`` earlier rows.

    Uses the moment aggregates (``covar_samp``/``stddev_samp``), which Spark merges
    with a numerically stable update, instead of raw power sums."""
    w = _w(keys, order).rowsBetween(-int(window), -1)
    both = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    xv, yv = F.when(both, F.col(x)), F.when(both, F.col(y))
    d = df.withColumn("_xv", xv).withColumn("_yv", yv)
    n = F.count("_xv").over(w)
    cov = F.covar_samp("_xv", "_yv").over(w)
    sx, sy = F.stddev_samp("_xv").over(w), F.stddev_samp("_yv").over(w)
    rn = F.row_number().over(_w(keys, order))
    r = F.try_divide(cov, sx * sy)
    r = F.when((rn > int(window)) & (n >= int(min_pairs)) & (sx > 0) & (sy > 0), r)
    # clamp float noise outside [-1, 1] (greatest/least skip NULLs, so guard them)
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return d.withColumn(out, r).drop("_xv", "_yv")


def normalise_by_max_abs(df: DataFrame, value: str, keys: Sequence[str], out: str | None = None) -> DataFrame:
    """|x| / max |x| per key, NULL/NaN -> 0."""
    m = F.max(F.abs(value)).over(Window.partitionBy(*keys))
    v = F.try_divide(F.abs(value), m)
    return df.withColumn(out or f"{value}_norm", F.coalesce(F.nanvl(v, F.lit(None)), F.lit(0.0)))


def tail_rows(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last n rows per key with position from the end (1 = last)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("pos_from_end", F.row_number().over(w)).filter(F.col("pos_from_end") <= int(n))


def tail_change(df: DataFrame, value: str, n: int, keys: Sequence[str], order: Sequence[str],
                threshold_pct: float = 5.0) -> DataFrame:
    """P28 + W12: first/last of the last n points, % change and the drop alert."""
    t = tail_rows(df, n, keys, order)
    agg = t.groupBy(*keys).agg(
        F.max_by(value, "pos_from_end").alias("first_value"),
        F.min_by(value, "pos_from_end").alias("last_value"),
        F.count(F.lit(1)).alias("n_points"))
    pct = F.try_divide(F.col("last_value") - F.col("first_value"), F.col("first_value")) * 100
    return agg.withColumn("change_pct", pct) \
              .withColumn("drop_alert", F.coalesce(F.col("change_pct") < -float(threshold_pct), F.lit(False)))


def week_spine(df: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """All week labels (Sunday ends) between the first and last week per key."""
    b = df.groupBy(*keys).agg(F.min(week_label(ts)).alias("lo"), F.max(week_label(ts)).alias("hi"))
    return b.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 7 DAYS"))).alias("week"))


def weekly_mean(df: DataFrame, ts: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pandas ``resample('W').mean()``: Mon-Sun weeks labelled by the Sunday,
    empty weeks kept as NULL rows."""
    g = df.groupBy(*keys, week_label(ts).alias("week")).agg(*[F.avg(v).alias(v) for v in values])
    return week_spine(df, ts, keys).join(g, [*keys, "week"], "left")


def weekly_sign_counts(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """A10: weekly count of value == 1 and value == -1; empty weeks are 0."""
    g = df.groupBy(*keys, week_label(ts).alias("week")).agg(
        F.count_if(F.col(value) == 1).alias("positive_count"),
        F.count_if(F.col(value) == -1).alias("negative_count"))
    sp = week_spine(df, ts, keys)
    return sp.join(g, [*keys, "week"], "left").fillna(0, subset=["positive_count", "negative_count"])
