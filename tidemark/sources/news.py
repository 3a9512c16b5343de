"""Scans and sinks for the news and energy inputs.

Explicit schemas everywhere: no ``inferSchema`` pass over the data, and bad lines
are dropped at the scan (``DROPMALFORMED``), like ``on_bad_lines='skip'``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timecal import parse_ts, shift_hours

NEWS_COLUMNS = ["publishedAt", "title", "source", "description", "url"]

NEWS_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in NEWS_COLUMNS])

NEWS_JSON_SCHEMA = T.StructType([
    T.StructField("publishedAt", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("source", T.StructType([T.StructField("id", T.StringType(), True),
                                          T.StructField("name", T.StringType(), True)]), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
])


def _read_csv(spark: SparkSession, path: str | Sequence[str], multi_line: bool) -> DataFrame:
    """All columns of the header as strings.  A row with more fields than the header is left
    out; a row with fewer is padded with nulls (one sentinel column tells them apart)."""
    def reader():
        return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')

    names = reader().csv(path).columns
    more = "_more"
    while more in names:
        more += "_"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, more]])
    rows = reader().schema(schema).option("mode", "PERMISSIVE").option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    return rows.filter(F.col(more).isNull()).select(*[F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def read_news_csv(spark: SparkSession, path: str | Sequence[str],
                  columns: Sequence[str] = NEWS_COLUMNS) -> DataFrame:
    """News CSV scan by header name; extra columns are ignored, rows with too many fields
    left out, short ones padded, quoted multi-line fields allowed (one task per file; give
    many files); ``publishedAt`` parsed zone-free."""
    df = _read_csv(spark, path, multi_line=True)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"news CSV lacks columns {missing}")
    out = df.select(*[F.col(f"`{c}`") for c in columns])
    return out.withColumn("publishedAt", parse_ts("publishedAt"))


# Energy columns that are not used downstream.
UNUSED_ENERGY_COLUMNS = ["Nuclear", "Renewable", "Non-Renewable"]


def read_energy_csv(spark: SparkSession, path: str | Sequence[str], *,
                    ts_col: str = "Timestamp", shift: int = -1,
                    numeric: Sequence[str] | None = None) -> DataFrame:
    """S2 + P4 + P5: energy CSV with double columns, timestamps moved back ``shift`` hours
    (Q21) and the unused columns dropped when present."""
    df = _read_csv(spark, path, multi_line=False)
    cols = [c for c in df.columns if c != ts_col]
    numeric = list(numeric) if numeric is not None else cols
    out = df.select(shift_hours(parse_ts(ts_col), shift).alias(ts_col),
                    *[F.col(f"`{c}`").cast("double").alias(c) if c in numeric else F.col(f"`{c}`")
                      for c in cols])
    return drop_if_present(out, UNUSED_ENERGY_COLUMNS)


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: drop columns if they exist (``DataFrame.drop`` ignores unknown names)."""
    return df.drop(*cols)


def read_news_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Nested article records -> flat news rows with the fetcher's defaults
    (missing title/description/url -> empty string; source -> source.name)."""
    raw = spark.read.schema(NEWS_JSON_SCHEMA).json(path)
    return flatten_articles(raw)


def flatten_articles(raw: DataFrame) -> DataFrame:
    return raw.select(
        parse_ts("publishedAt").alias("publishedAt"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.col("source.name").alias("source"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
    )


def merge_batches(spark: SparkSession, paths: Sequence[str], fmt: str = "csv") -> DataFrame:
    """S10/SET1: union of daily batch files with their origin recorded.

    One multi-path scan (Spark lists and splits all files in parallel) instead of a
    driver-side loop of unions."""
    if fmt == "csv":
        df = read_news_csv(spark, list(paths))
    elif fmt == "json":
        df = read_news_json(spark, list(paths))
    else:
        df = spark.read.format(fmt).load(list(paths))
    return df.withColumn("batch_file", F.input_file_name())


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """SET1: ``unionByName`` with missing columns as NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header (one folder of part files, written in parallel)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
