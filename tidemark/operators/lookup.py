"""Dimension lookups.

Configuration dimensions (topic -> valence, label -> short label, group -> leaves)
are small and fixed by the configuration, not by the data, so they are inlined as a
``map`` literal: one hash lookup per row inside codegen, no join and no shuffle.
A dimension that is itself a large table is a plain left join: AQE picks a broadcast
only when the measured size allows it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_literal(mapping: Mapping):
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def valence_lookup(df: DataFrame, topic: str, valence: Mapping[str, int], out: str = "valence") -> DataFrame:
    """Topic -> valence, unknown -> 0."""
    m = map_literal(valence)
    return df.withColumn(out, F.coalesce(F.element_at(m, F.col(topic)), F.lit(0)).cast("bigint"))


def short_label(df: DataFrame, label: str, short: Mapping[str, str], out: str = "short_label") -> DataFrame:
    """Label -> short label, unknown -> the label itself."""
    m = map_literal(short)
    return df.withColumn(out, F.coalesce(F.element_at(m, F.col(label)), F.col(label)))


def resolve_column(df: DataFrame, candidates) -> str | None:
    """P10: first candidate name present in the frame (plan-time, no data read)."""
    for c in candidates:
        if c in df.columns:
            return c
    return None


def only(col: str, allowed, what: str):
    """The column, raising on a non-null value outside of ``allowed``: a pivot over a fixed list would drop it."""
    c = F.col(col)
    bad = F.raise_error(F.concat(F.lit(f"{what} outside of the list: "), c.cast("string")))
    return F.when(c.isNull() | c.isin(*allowed), c).otherwise(bad).alias(col)
