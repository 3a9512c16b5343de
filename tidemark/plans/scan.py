"""Scans over ordered rows for series of any length.

``Window.partitionBy(series).orderBy(ts)`` sends a whole series to one task.  Here the rows
are cut once into ranges of (key, order) with about equal numbers of rows (``ranged``); each
range is windowed on its own, and what a row needs from other ranges comes from the few
range rows: counts and sums as carries, fills as first and last values, and shifts and
rolling frames as copies of the rows at the borders (``windowed``).  The cut follows the rows,
so a month, a score or a key that holds most of them is spread over as many tasks as any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def _join_blocks(d: DataFrame, blocks: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Join per-block values back; null keys and null blocks match themselves."""
    b = blocks.select(*[F.col(c).alias(f"_j_{c}") if c in cols else F.col(c) for c in blocks.columns])
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return d.join(b, same).drop(*[f"_j_{c}" for c in cols])


def ranged(df: DataFrame, by: Sequence[str], out: str = "_part", n: int | None = None, pos: str | None = None) -> DataFrame:
    """The rows with the number of their range partition: borders come from a sample, so ranges
    hold about equal numbers of rows whatever the values are, and ties of ``by`` stay together.
    ``pos`` names a column for a number that ascends by ``by`` in all rows and is gapless inside
    a range.  Stored, so that the numbers hold however often the result is read."""
    from tidemark.session import cut_lineage
    parts = n or max(2 * df.sparkSession.sparkContext.defaultParallelism, 8)
    d = df.repartitionByRange(parts, *by)
    if pos:
        d = d.sortWithinPartitions(*by).withColumn(pos, F.monotonically_increasing_id())
    return cut_lineage(d.withColumn(out, F.spark_partition_id()))


def _range_rows(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _part, _lo, _hi, _first): the 1-based numbers of a range's first and last row within
    the key, and the ``_pos`` of the first."""
    sizes = d.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part"))  # one row per range
    return sizes.select(*keys, "_part", "_first", (upto - F.col("_n") + 1).alias("_lo"), upto.alias("_hi"))


def prefix_sums(d: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Add, for every ``out: value`` of ``sums``, the sum of ``value`` over the key's rows before this
    one.  ``d`` comes from ``ranged(df, [*keys, *order])``; ``order`` is unique within a key."""
    keys = list(keys)
    totals = d.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carry = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_c_{o}") for o in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{o}") for o, v in sums.items()])
    d = _join_blocks(d, carry, [*keys, "_part"])
    return d.select(*[c for c in d.columns if not c.startswith(("_c_", "_i_"))], *[(F.col(f"_c_{o}") + F.col(f"_i_{o}")).alias(o) for o in sums])


def neighbours(d: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>``: the nearest non-null value of each column before and after
    the row, across ranges.  ``d`` as for ``prefix_sums``; each range hands on its first and last."""
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    back, ahead = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(1, Window.unboundedFollowing)
    at = F.struct(*order)
    # max_by and min_by over the non-null rows: partial aggregation, one row per range
    ends = d.groupBy(*keys, "_part").agg(*[x for c in cols for x in (
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_z_{c}"), F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_a_{c}"))])
    parts = Window.partitionBy(*keys).orderBy("_part")
    ends = ends.select(*keys, "_part", *[x for c in cols for x in (
        F.last(f"_z_{c}", True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_l_{c}"),
        F.first(f"_a_{c}", True).over(parts.rowsBetween(1, Window.unboundedFollowing)).alias(f"_f_{c}"))])
    d = d.select("*", *[x for c in cols for x in (F.last(c, True).over(back).alias(f"_b_{c}"), F.first(c, True).over(ahead).alias(f"_n_{c}"))])
    d = _join_blocks(d, ends, [*keys, "_part"])
    own = [c for c in d.columns if not c.startswith(("_b_", "_n_", "_l_", "_f_"))]
    return d.select(*own, *[x for c in cols for x in (F.coalesce(f"_b_{c}", f"_l_{c}").alias(f"prev_{c}"),
                                                      F.coalesce(f"_n_{c}", f"_f_{c}").alias(f"next_{c}"))])


def ranked_rows(df: DataFrame, order: Sequence[str], out: str = "rank") -> DataFrame:
    """Gapless 0-based number of all rows by ``order`` (unique)."""
    return global_row_number(df, [], order, "_rn").withColumn(out, F.col("_rn") - 1).drop("_rn", "n_rows")


def global_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      out: str = "rn", n: int | None = None) -> DataFrame:
    """1-based row number per ``keys`` ordered by ``order``, plus ``n_rows`` = rows per key: the
    place in the sorted range and the counts of the ranges before, without a window over rows."""
    keys, order = list(keys), list(order)
    d = ranged(df, [*keys, *order], n=n, pos="_pos")
    rows = _range_rows(d, keys).withColumn("n_rows", F.max("_hi").over(Window.partitionBy(*keys)))
    return (_join_blocks(d, rows, [*keys, "_part"])
            .withColumn(out, (F.col("_lo") + F.col("_pos") - F.col("_first")).cast("bigint"))
            .drop("_part", "_pos", "_first", "_lo", "_hi"))


def windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int,
             cols: dict[str, Callable[[WindowSpec], Column]], n: int | None = None) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    Each range of a key gets copies of the last ``before`` rows in front of it and the first
    ``after`` rows behind it, from as many neighbour ranges as that takes; ranges are windowed
    on their own and the copies dropped.  ``cols`` maps a name to a function of the window over
    (keys, range) by ``order``, to which it may add a frame; the row number within the whole key
    is the column ``_rn``.  Rows that tie in ``order`` keep one order throughout."""
    keys, order = list(keys), list(order)
    d = ranged(df, [*keys, *order], n=n, pos="_pos")
    rows = _range_rows(d, keys)
    # the ranges that look into this one: at most one neighbour per row of the halo can do so
    near = Window.partitionBy(*keys).orderBy("_part").rowsBetween(-max(int(after), 0), max(int(before), 0))
    rows = rows.select("*", F.collect_list(F.struct("_part", "_lo", "_hi")).over(near).alias("_near"))
    rows = rows.select(*keys, "_part", "_first", "_lo", F.filter("_near", lambda x: (
        ((x["_part"] > F.col("_part")) & (F.col("_hi") > x["_lo"] - 1 - int(before)))
        | ((x["_part"] < F.col("_part")) & (F.col("_lo") <= x["_hi"] + int(after))))).alias("_near"))
    d = _join_blocks(d, rows, [*keys, "_part"])
    d = d.withColumn("_rn", F.col("_lo") + F.col("_pos") - F.col("_first"))
    wanted = F.filter("_near", lambda x: ((x["_part"] > F.col("_part")) & (F.col("_rn") > x["_lo"] - 1 - int(before)))
                      | ((x["_part"] < F.col("_part")) & (F.col("_rn") <= x["_hi"] + int(after))))
    places = F.concat(F.array(F.col("_part")), F.transform(wanted, lambda x: x["_part"]))
    d = d.select(*df.columns, "_rn", F.col("_part").alias("_home"), F.explode(places).alias("_part"))
    w = Window.partitionBy(*keys, "_part").orderBy("_rn")
    d = d.select("*", *[make(w).alias(name) for name, make in cols.items()])
    return d.filter(F.col("_home") == F.col("_part")).drop("_rn", "_home", "_part")


def running_drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                     n: int | None = None) -> DataFrame:
    """equity = running sum of ``value``, running max of the equity, drawdown; every range
    starts from the sum and the best equity of the ranges before it."""
    keys, order = list(keys), list(order)
    d = ranged(df, [*keys, *order], n=n, pos="_pos")
    inside = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_run", F.sum(value).over(inside))
    d = d.withColumn("_rmax", F.max("_run").over(inside))
    per = d.groupBy(*keys, "_part").agg(F.sum(value).alias("_bs"), F.max("_run").alias("_bm"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_part", F.sum("_bs").over(earlier).alias("_carry"), "_bm")
    # best equity of earlier ranges = max over them of (their carry + their best)
    per = per.withColumn("_prevmax", F.max(F.coalesce("_carry", F.lit(0.0)) + F.col("_bm")).over(earlier))
    j = _join_blocks(d, per.drop("_bm"), [*keys, "_part"])
    # a sum of nulls alone is null, as in a plain running sum
    eq = F.when(F.col("_carry").isNull(), F.col("_run")).otherwise(F.col("_carry") + F.coalesce("_run", F.lit(0.0)))
    best = F.coalesce("_carry", F.lit(0.0)) + F.col("_rmax")
    return (j.withColumn("equity", eq).withColumn("running_max", F.greatest("_prevmax", best))  # greatest skips nulls
             .withColumn("drawdown", F.col("equity") - F.col("running_max"))
             .withColumn("drawdown_pct", F.try_divide(F.col("drawdown"), F.nullif(F.col("running_max"), F.lit(0.0))) * 100)
             .drop("_part", "_pos", "_run", "_rmax", "_carry", "_prevmax"))
