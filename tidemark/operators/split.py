"""Chronological splits and time-series folds.

Row positions come from ``plans.scan.global_row_number`` (ranges of equal row counts, so a
single long series or a dense month is not funnelled through one task).  Fold membership is generated with
``explode(sequence(...))`` per row: no fold-table join, no nested loop.  Guards that
the reference raises eagerly are ``raise_error`` expressions evaluated lazily on
the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scan import global_row_number

# Reference defaults.
TRAIN_RATIO, VAL_RATIO, TEST_RATIO = 0.7, 0.2, 0.1
N_SPLITS, STEP, MIN_TRAIN = 8, 72, 336


def chrono_split(df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("ts",),
                 train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO,
                 test_ratio: float = TEST_RATIO, gap: int = 0, strict: bool = True) -> DataFrame:
    """``split`` in {train, val, test} by ``int(n * ratio)`` cut points per key.

    ``gap`` rows after each cut point are dropped (Q18 leakage guard; 0 = reference).
    A key too short for three parts raises; with ``strict=False`` its empty parts stay empty."""
    if abs(train_ratio + val_ratio + test_ratio - 1.0) > 1e-8:
        raise ValueError("Split ratios must sum to 1.0")
    d = global_row_number(df, keys, order, "rn")
    n = F.col("n_rows")
    train_end = F.floor(n * F.lit(float(train_ratio)))
    val_end = train_end + F.floor(n * F.lit(float(val_ratio)))
    bad = (train_end == 0) | (val_end == train_end) | (val_end >= n)
    i = F.col("rn") - 1
    split = (F.when(F.lit(strict) & bad, F.raise_error(F.lit("Invalid split sizes")))
             .when(i < train_end, F.lit("train"))
             .when(i < val_end, F.lit("val"))
             .otherwise(F.lit("test")))
    out = d.withColumn("split", split.cast("string"))
    if gap:
        keep = ~(((i >= train_end) & (i < train_end + gap)) | ((i >= val_end) & (i < val_end + gap)))
        out = out.filter(keep)
    return out.withColumn("row_index", i).drop("rn", "n_rows")


def expanding_folds(df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("ts",),
                    n_splits: int = N_SPLITS, step: int = STEP, min_train: int = MIN_TRAIN) -> DataFrame:
    """Fold i trains on rows [0, m + i*s) and tests on [m + i*s, m + (i+1)*s).

    Output: input rows x (fold, role) for every fold the row takes part in."""
    if n_splits < 1 or step < 1 or min_train < 1:
        raise ValueError("n_splits, step_size and min_train_size must be at least 1")
    d = global_row_number(df, keys, order, "rn")
    i = F.col("rn") - 1
    n = F.col("n_rows")
    possible = F.when(n <= min_train, F.lit(0)).otherwise(F.floor((n - min_train) / step))
    rel = i - F.lit(min_train)
    test_fold = F.when(rel >= 0, F.floor(rel / step)).cast("int")
    first_train = F.when(rel < 0, F.lit(0)).otherwise(test_fold + 1).cast("int")
    last = F.lit(int(n_splits) - 1)
    train_folds = F.when(first_train <= last, F.sequence(first_train, last)) \
                   .otherwise(F.array().cast("array<int>"))
    test_part = F.when(test_fold.isNotNull() & (test_fold <= last),
                       F.array(F.struct(test_fold.alias("fold"), F.lit("test").alias("role")))) \
                 .otherwise(F.array().cast("array<struct<fold:int,role:string>>"))
    cells = F.concat(F.transform(train_folds, lambda f: F.struct(f.alias("fold"), F.lit("train").alias("role"))),
                     test_part)
    # the guard sits inside the exploded column, so column pruning cannot drop it
    cells = F.when(possible < n_splits, F.raise_error(F.format_string(
        "Requested %d splits, but only %d are possible", F.lit(int(n_splits)), possible.cast("int")))) \
        .otherwise(cells)
    return (d.select("*", F.explode(cells).alias("_c"))
            .select(*df.columns, i.alias("row_index"), F.col("_c.fold").cast("bigint").alias("fold"),
                    F.col("_c.role").alias("role")))


def with_test_fold(df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("ts",),
                   n_splits: int = 5) -> DataFrame:
    """W11 by row: add ``test_fold``, the one fold that tests on the row (-1: none, the row
    comes before all test blocks).  A key of n rows gets ``min(n_splits, n - 1)`` folds, and
    none at all where that is below two."""
    d = global_row_number(df, keys, order, "rn")
    n = F.col("n_rows")
    k = F.least(F.lit(int(n_splits)), n - 1)
    size = F.floor(n / (k + 1))
    rel = F.col("rn") - 1 - (n - k * size)
    fold = F.when((k >= 2) & (rel >= 0), F.floor(rel / size)).otherwise(F.lit(-1))
    return d.select(*df.columns, fold.cast("int").alias("test_fold"))


def time_series_folds(df: DataFrame, keys: Sequence[str] = ("series_id",), order: Sequence[str] = ("ts",),
                      n_splits: int = 5) -> DataFrame:
    """Scikit-learn style ``TimeSeriesSplit``: test size n // (k+1), the k test
    blocks at the tail, train = everything before each test block."""
    d = global_row_number(df, keys, order, "rn")
    i = F.col("rn") - 1
    n = F.col("n_rows")
    k = int(n_splits)
    ts_ = F.floor(n / (k + 1))
    first_test_start = n - k * ts_
    rel = i - first_test_start
    test_fold = F.when(rel >= 0, F.floor(rel / ts_)).cast("int")
    first_train = F.when(rel < 0, F.lit(0)).otherwise(test_fold + 1).cast("int")
    last = F.lit(k - 1)
    train_folds = F.when(first_train <= last, F.sequence(first_train, last)) \
                   .otherwise(F.array().cast("array<int>"))
    test_part = F.when(test_fold.isNotNull(),
                       F.array(F.struct(test_fold.alias("fold"), F.lit("test").alias("role")))) \
                 .otherwise(F.array().cast("array<struct<fold:int,role:string>>"))
    cells = F.concat(F.transform(train_folds, lambda f: F.struct(f.alias("fold"), F.lit("train").alias("role"))),
                     test_part)
    cells = F.when(n < k + 1, F.raise_error(F.lit("Cannot have number of folds greater than samples"))) \
        .otherwise(cells)
    return (d.select("*", F.explode(cells).alias("_c"))
            .select(*df.columns, i.alias("row_index"), F.col("_c.fold").cast("bigint").alias("fold"),
                    F.col("_c.role").alias("role")))
