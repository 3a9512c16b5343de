"""Scans of the given parquet tables and the substitute views built from them.

The reference reads a news CSV and an hourly energy CSV that are not shipped; the
views below derive equivalent inputs from the driver's tables (see FIXTURES.md):

* ``energy_hourly``  - hourly series from ``events`` (one series, id ``'events'``)
* ``energy_daily``   - daily series from ``lineitem``, one series per return flag
* ``topic_news``     - ``events`` as classified articles (``event_type`` = topic)
* ``news``           - ``documents`` as news articles
* ``embedded_news``  - ``embeddings`` as embedded, topic-labelled articles
* ``predictions``    - ``orders`` as two models' class predictions
* ``actions``        - strategy actions over the hourly master table

Every view is lazy; Catalyst prunes the columns and pushes the filters to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.timecal import floor_hour, ntz

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the substitute views (FIXTURES.md section B).
NEWS_EPOCH = "2024-01-01 00:00:00"
NEWS_MINUTE_MULTIPLIER = 7919
NEWS_MINUTE_MODULUS = 43200
OTHER_TOPIC_EVENTS = "error"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _published_at(id_col: str):
    minutes = (F.col(id_col) * F.lit(NEWS_MINUTE_MULTIPLIER)) % F.lit(NEWS_MINUTE_MODULUS)
    return F.lit(NEWS_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as news: article_id, publishedAt, title, description, source, url."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("article_id"),
        _published_at("doc_id").alias("publishedAt"),
        F.col("text").alias("title"),
        F.col("text").alias("description"),
        F.col("source"),
        F.concat(F.lit("http://example.com/"), F.col("doc_id").cast("string")).alias("url"),
    )


def topic_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as classified articles: article_id, publishedAt, topic, score."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("article_id"),
        F.col("ts").alias("publishedAt"),
        F.col("event_type").alias("topic"),
        F.col("value").alias("score"),
    )


def embedded_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as embedded articles: article_id, publishedAt, topic, embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("article_id"),
        _published_at("vec_id").alias("publishedAt"),
        F.col("label").cast("string").alias("topic"),
        F.col("embedding"),
    )


def hour_spine(df: DataFrame, ts: str, series_id: str | None = None) -> DataFrame:
    """Every hour between the first and last hour present (per series).

    One row per series goes through ``sequence``; its size is the time span in
    hours, not the row count, so it stays small whatever the data volume.
    """
    keys = [series_id] if series_id else []
    bounds = df.groupBy(*keys).agg(F.min(floor_hour(ts)).alias("lo"),
                                   F.max(floor_hour(ts)).alias("hi"))
    return bounds.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR")))
                         .alias("ts"))


def energy_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly energy stand-in: series_id, ts, spot, da, load.

    spot = mean event value in the hour (0 when empty), load = sum (0 when empty),
    da = mean spot of the 24 preceding hours (NULL on the first hour).
    """
    e = table(spark, sf_dir, "events").select("ts", "value")
    hourly = (e.groupBy(floor_hour("ts").alias("ts"))
              .agg(F.avg("value").alias("spot_raw"), F.sum("value").alias("load_raw")))
    spine = hour_spine(hourly, "ts")  # from the hours already aggregated, not from the raw rows
    out = (spine.join(hourly, "ts", "left")
           .select(F.lit("events").alias("series_id"), "ts",
                   F.coalesce("spot_raw", F.lit(0.0)).alias("spot"),
                   F.coalesce("load_raw", F.lit(0.0)).alias("load")))
    w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(-24, -1)
    return out.withColumn("da", F.avg("spot").over(w)).select(
        "series_id", "ts", "spot", "da", "load")


def energy_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily multi-series stand-in from ``lineitem``: one series per return flag."""
    li = table(spark, sf_dir, "lineitem")
    unit = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    net_unit = F.try_divide(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_quantity"))
    return (li.groupBy(F.col("l_returnflag").alias("series_id"),
                       ntz(F.date_trunc("day", "l_shipdate")).alias("ts"))
            .agg(F.avg(unit).alias("spot"),
                 (F.lit(1.05) * F.avg(net_unit)).alias("da"),
                 F.sum("l_quantity").alias("load")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as predictions of two models, one row per (model, row_id).

    y_true: F->0, O->1, P->2; signal is right when key % 10 < 6, baseline when
    key % 7 < 4; proba[c] is proportional to 1 + (key*(c+3)) % 97 + 40*(c = y).
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    y = (F.when(F.col("o_orderstatus") == "F", 0)
         .when(F.col("o_orderstatus") == "O", 1)
         .when(F.col("o_orderstatus") == "P", 2)).cast("bigint")
    k = F.col("o_orderkey")
    base = o.select(k.alias("row_id"), y.alias("y_true"))
    sig = F.when(F.col("row_id") % 10 < 6, F.col("y_true")).otherwise((F.col("y_true") + 1) % 3)
    bas = F.when(F.col("row_id") % 7 < 4, F.col("y_true")).otherwise((F.col("y_true") + 2) % 3)

    def raw(c: int):
        return (F.lit(1) + (F.col("row_id") * (c + 3)) % 97
                + F.when(F.col("y_true") == c, 40).otherwise(0)).cast("double")

    total = raw(0) + raw(1) + raw(2)
    proba = F.array(*[raw(c) / total for c in range(3)])
    models = F.array(
        F.struct(F.lit("signal").alias("model"), sig.cast("bigint").alias("y_pred")),
        F.struct(F.lit("baseline").alias("model"), bas.cast("bigint").alias("y_pred")))
    return (base.select("row_id", "y_true", proba.alias("proba"), F.explode(models).alias("m"))
            .select(F.col("m.model").alias("model"), "row_id", "y_true",
                    F.col("m.y_pred").alias("y_pred"), "proba"))


def actions(spark: SparkSession, sf_dir: str, master: DataFrame | None = None) -> DataFrame:
    """Strategy actions over the hourly master: long (+1), signal (sign of the
    previous spread), baseline ((row_number % 3) - 1)."""
    from tidemark.plans.ingest import master_table
    m = master if master is not None else master_table(energy_hourly(spark, sf_dir))
    w = Window.partitionBy("series_id").orderBy("ts")
    prev = F.lag("real_spread_abs", 1).over(w)
    rn = F.row_number().over(w)
    base = m.select("series_id", "ts", "spot", "da", "real_spread_abs",
                    "real_spread_abs_shift_24",
                    F.coalesce(F.signum(prev).cast("bigint"), F.lit(0).cast("bigint")).alias("a_signal"),
                    ((rn % 3) - 1).cast("bigint").alias("a_baseline"))
    strategies = F.array(
        F.struct(F.lit("long").alias("strategy"), F.lit(1).cast("bigint").alias("action")),
        F.struct(F.lit("signal").alias("strategy"), F.col("a_signal").alias("action")),
        F.struct(F.lit("baseline").alias("strategy"), F.col("a_baseline").alias("action")))
    return (base.select("series_id", "ts", "spot", "da", "real_spread_abs",
                        "real_spread_abs_shift_24", F.explode(strategies).alias("s"))
            .select(F.col("s.strategy").alias("strategy"), "series_id", "ts", "spot", "da",
                    "real_spread_abs", "real_spread_abs_shift_24", F.col("s.action").alias("action")))
