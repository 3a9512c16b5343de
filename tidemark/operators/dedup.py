"""Sorting, dedup, sampling and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup_keep_earliest(df: DataFrame, key: str = "title", order: Sequence[str] = ("publishedAt",),
                        tiebreak: str = "article_id") -> DataFrame:
    """K2: one row per ``key``: the earliest by (order..., tiebreak).

    ``min_by`` is an ordinary aggregate, so Spark combines partially on the map side:
    a title repeated in a third of all rows shrinks to one row per task before the
    shuffle (a sort-based ``row_number`` window would send them all to one task)."""
    cols = [c for c in df.columns if c != key]
    ordering = F.struct(*[F.col(c) for c in order], F.col(tiebreak))
    return (df.groupBy(key)
            .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), ordering).alias("_r"))
            .select(key, *[F.col("_r")[c].alias(c) for c in cols]))


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Deterministic sample of ``n`` rows ordered by md5(seed-key).

    Planned as TakeOrderedAndProject: each task keeps its own top n, the driver
    merges n x tasks rows, never the table."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(int(n)).drop("_h")


def top_n(df: DataFrame, n: int, by: Sequence[Column | str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """K5/K6: ordered head (the limit is the feature: a top-k report)."""
    return df.orderBy(*by, *tiebreak).limit(int(n))
