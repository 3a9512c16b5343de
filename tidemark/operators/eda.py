"""Exploratory aggregates behind the report tables.

All are grouped aggregates with partial (map-side) combination; shares use a
window over the already aggregated rows only (a handful of groups), never over the
raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_counts(df: DataFrame, col: str, keys: Sequence[str] = (), dropna: bool = True) -> DataFrame:
    """A4: count and percentage per value (pandas ``value_counts`` drops NULL)."""
    d = df.filter(F.col(col).isNotNull()) if dropna else df
    g = d.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("count"))
    return with_share(g, "count", keys, "pct")


def with_share(g: DataFrame, value: str, keys: Sequence[str], out: str, scale: float = 100.0) -> DataFrame:
    """W13 on aggregated rows: share of the total of the keys (null keys are a group too)."""
    return g.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy(*keys)) * scale)


def top_n_counts(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """A5: the n most frequent values (ties by value), share of the n shown (Q16).

    Counting is a partial aggregate; the top-n is TakeOrderedAndProject on the
    (small) per-value counts."""
    g = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    top = g.orderBy(F.col("count").desc(), F.col(col)).limit(int(n))
    w = Window.partitionBy()
    return (top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col(col))))
               .withColumn("pct_of_shown", F.col("count") / F.sum("count").over(w) * 100))


def mean_by(df: DataFrame, key, value: str, out: str | None = None) -> DataFrame:
    """Mean of ``value`` by an expression (hour of day, weekday ...)."""
    return df.groupBy(key).agg(F.avg(value).alias(out or f"mean_{value}"))


def hourly_counts_with_peak(df: DataFrame, ts: str) -> DataFrame:
    """Rows per hour of day and the peak hour (first hour wins on ties)."""
    g = df.groupBy(F.hour(ts).cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.orderBy(F.col("count").desc(), F.col("hour"))
    return g.withColumn("is_peak", F.row_number().over(w) == 1)


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per calendar day (only days present); the day is a midnight timestamp."""
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")
    return df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram over [min, max] with the last bin closed, every bin
    listed (zero counts included).

    The range is one small aggregate read back as two scalars (like fitting a
    bucketizer); bucketing and counting are then a single grouped aggregate."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin bigint, lo double, hi double, count bigint")
    lo, hi = float(lo), float(hi)
    width = (hi - lo) if hi > lo else 1.0
    norm = bins / width
    idx = F.least(F.floor((F.col(col) - F.lit(lo)) * F.lit(norm)), F.lit(bins - 1)).cast("bigint")
    counts = df.filter(F.col(col).isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    step = (hi - lo) / bins
    edges = spark.range(bins).select(F.col("id").alias("bin"),
                                     (F.lit(lo) + F.col("id") * F.lit(step)).alias("lo"),
                                     F.when(F.col("id") == bins - 1, F.lit(hi))
                                      .otherwise(F.lit(lo) + (F.col("id") + 1) * F.lit(step)).alias("hi"))
    return edges.join(counts, "bin", "left").select("bin", "lo", "hi",
                                                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], lower: bool = True) -> DataFrame:
    """Pairwise-complete Pearson correlation of numeric columns (pandas
    ``DataFrame.corr``), lower triangle incl. diagonal, NULL for constant pairs.

    One global aggregate computes every pair's moments in a single pass."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[: i + 1]] if lower else \
        [(a, b) for a in cols for b in cols]
    aggs = []
    for k, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)
        xa, xb = F.when(both, F.col(a)), F.when(both, F.col(b))
        aggs += [F.covar_samp(xa, xb).alias(f"c{k}"), F.stddev_samp(xa).alias(f"sa{k}"),
                 F.stddev_samp(xb).alias(f"sb{k}")]
    one = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                               F.when((F.col(f"sa{k}") > 0) & (F.col(f"sb{k}") > 0),
                                      F.col(f"c{k}") / (F.col(f"sa{k}") * F.col(f"sb{k}"))).alias("corr"))
                      for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("c")).select("c.col_a", "c.col_b", "c.corr")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], bins: int = 1024) -> list[float | None]:
    """Exact linear-interpolated quantiles (pandas/NumPy 'linear', DuckDB
    ``quantile_cont``) without collecting rows, the same way at any size.

    The value of a rank is found by histogram narrowing: a grouped count over ``bins``
    equal-width bins of the current value range (``bins`` rows), keep the bin that holds the
    rank and its least and largest value, repeat until both are equal.  The next larger
    value, for interpolation, is one more aggregate."""
    from tidemark.session import cut_lineage
    # the search makes a few passes: materialise the single value column once
    x = cut_lineage(df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")))
    n, lowest, highest = x.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()

    def kth(rank: int) -> tuple[float, int]:
        """The value of a rank and how many values are at or below it."""
        lo, hi, below, inside = lowest, highest, 0, n
        while lo < hi:
            width = (hi - lo) / bins
            at = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)) if width > 0 else (F.col("v") > lo).cast("bigint")
            rows = (x.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy(at.alias("b"))
                    .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx")).orderBy("b").collect())
            for row in rows:
                if below + row["c"] > rank:
                    lo, hi, inside = row["mn"], row["mx"], row["c"]
                    break
                below += row["c"]
        return lo, below + inside

    def quantile(q: float) -> float:
        at = q * (n - 1)
        value, upto = kth(int(np.floor(at)))
        part = at - np.floor(at)
        if part == 0 or upto > np.floor(at) + 1:
            return value
        return value + (x.filter(F.col("v") > value).agg(F.min("v")).first()[0] - value) * part

    return [quantile(q) if n else None for q in probs]


def exact_quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], bins: int = 256) -> dict[str, list[float | None]]:
    """``exact_quantiles`` of several columns at once: all ranks of all columns are narrowed in the
    same passes, each one grouped count of at most columns x ranks x ``bins`` rows."""
    from tidemark.session import cut_lineage
    spark = df.sparkSession
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(cols)]))
    x = cut_lineage(df.select(pairs.alias("p")).select("p.c", "p.v").filter(F.col("v").isNotNull() & ~F.isnan("v")))
    ends = {r["c"]: r for r in x.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    places = {(c, q): q * (r["n"] - 1) for c, r in ends.items() for q in probs}
    wanted = {(c, int(np.floor(at)) + k) for (c, q), at in places.items() for k in (0, 1) if int(np.floor(at)) + k < ends[c]["n"]}
    state = {(c, rank): (ends[c]["lo"], ends[c]["hi"], 0) for c, rank in wanted}
    while True:
        live = [(c, rank, lo, hi) for (c, rank), (lo, hi, _) in state.items() if lo < hi]
        if not live:
            break
        ranges = spark.createDataFrame(live, "rc int, rank bigint, lo double, hi double")  # columns x ranks rows
        width = (F.col("hi") - F.col("lo")) / bins
        at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise((F.col("v") > F.col("lo")).cast("bigint"))
        counted = (x.join(F.broadcast(ranges), (F.col("c") == F.col("rc")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
                   .groupBy("c", "rank", at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                   .orderBy("c", "rank", "b").collect())
        found: set = set()
        for r in counted:  # bins in ascending order: the first that reaches the rank holds it
            key = (r["c"], r["rank"])
            lo, hi, below = state[key]
            if key in found:
                continue
            if below + r["n"] > r["rank"]:
                found.add(key)
                state[key] = (r["mn"], r["mx"], below)
            else:
                state[key] = (lo, hi, below + r["n"])

    def value(c: int, q: float) -> float | None:
        if c not in ends:
            return None
        at = places[(c, q)]
        low, part = int(np.floor(at)), at - np.floor(at)
        a = state[(c, low)][0]
        return a if part == 0 else a + (state[(c, low + 1)][0] - a) * part

    return {name: [value(i, q) for q in probs] for i, name in enumerate(cols)}


def topic_stats(df: DataFrame, topic: str, score: str, other_label: str) -> DataFrame:
    """Mean and median score, share of the "other" topic, distinct topics and
    non-null topic count; the median is exact and distributed (``exact_quantiles``)."""
    med = exact_quantiles(df, score, [0.5])[0]
    return df.agg(
        F.avg(score).alias("mean_score"),
        (F.count_if(F.col(topic) == other_label) / F.count(F.lit(1)) * 100).alias("other_pct"),
        F.count_distinct(topic).alias("n_topics"),
        F.count(topic).alias("n_classified")).withColumn("median_score", F.lit(med).cast("double"))


def category_importance(imp: DataFrame, feature: str = "feature", value: str = "importance",
                        nlp_prefix: str = "news_") -> DataFrame:
    """Importance summed by feature category with share of the total."""
    from tidemark.functions.text import feature_category
    g = imp.groupBy(feature_category(feature, nlp_prefix).alias("category")).agg(F.sum(value).alias("importance"))
    return g.withColumn("pct", F.col("importance") / F.sum("importance").over(Window.partitionBy()) * 100)


def kde_density(df: DataFrame, features: Sequence[str], group: str | None = None, grid_size: int = 1000,
                cutoff: float = 8.0) -> DataFrame:
    """Gaussian KDE per feature (and group) as pandas ``plot(kind='density')``:
    Scott bandwidth h = std(ddof=1) * n^(-1/5), evaluated on ``grid_size`` points
    spanning [min - range/2, max + range/2].

    Each row adds to the grid points within ``cutoff`` bandwidths: beyond 8h its kernel is
    below 1e-14 of the peak, under the precision of the sum.  Work so grows with rows x
    (16h / grid step), not rows x grid.  Every grid point of every (feature, group) is
    returned; the stats table that spans the grid has one row for each of them."""
    keys = ["feature"] + ([group] if group else [])
    stack = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("x"))
                      for f in features])
    long = df.select(*([group] if group else []), F.explode(stack).alias("s")) \
             .select(*([group] if group else []), "s.feature", "s.x").filter(F.col("x").isNotNull() & ~F.isnan("x"))
    st = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
                                 F.min("x").alias("mn"), F.max("x").alias("mx"))
    st = st.filter((F.col("n") > 1) & (F.col("sd") > 0))
    rng = F.col("mx") - F.col("mn")
    st = st.select(*keys, "n", (F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))).alias("h"),
                   (F.col("mn") - 0.5 * rng).alias("g0"), ((2.0 * rng) / (grid_size - 1)).alias("step"))
    j = long.join(st, keys)
    lo = F.greatest(F.ceil((F.col("x") - cutoff * F.col("h") - F.col("g0")) / F.col("step")), F.lit(0))
    hi = F.least(F.floor((F.col("x") + cutoff * F.col("h") - F.col("g0")) / F.col("step")), F.lit(grid_size - 1))
    e = j.select(*keys, "x", "h", "n", "g0", "step", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("gi"))
    gx = F.col("g0") + F.col("gi") * F.col("step")
    z = (gx - F.col("x")) / F.col("h")
    contrib = F.exp(-0.5 * z * z)
    dens = e.groupBy(*keys, "gi").agg(F.sum(contrib).alias("s"))
    grid = st.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "h", "g0", "step",
                     F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("_gi"))
    same = F.col("_gi") == F.col("gi")
    for k in keys:
        same = same & F.col(f"_{k}").eqNullSafe(F.col(k))
    full = grid.join(dens.select(*keys, "gi", "s"), same, "left")
    return full.select(*[F.col(f"_{k}").alias(k) for k in keys], F.col("_gi").cast("bigint").alias("grid_index"),
                       (F.col("g0") + F.col("_gi") * F.col("step")).alias("x"),
                       (F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("h") * F.lit(float(np.sqrt(2 * np.pi))))).alias("density"))
