"""Scalar helpers."""

from pyspark.sql import functions as F

from tidemark.functions.numeric import argmax_array, safe_div
from tidemark.functions.text import feature_category, is_blank, sanitize_feature_name, truncate_label
from tidemark.operators.lookup import resolve_column


def test_string_helpers(spark):
    df = spark.createDataFrame([("Größe Überschuss (EUR)", "abcdefghijklmnop", "spot_price_lag", "  \t")],
                               "a string, b string, c string, d string")
    r = df.select(sanitize_feature_name("a").alias("s"), truncate_label("b", 8).alias("t"),
                  feature_category("c").alias("k"), is_blank("d").alias("bl"),
                  feature_category(F.lit("news_topic_x")).alias("k2"),
                  feature_category(F.lit("hydro_mw")).alias("k3"), feature_category(F.lit("ln1"), "ln").alias("k4"),
                  sanitize_feature_name(F.lit("CO₂ Ő½")).alias("s2")).first()
    assert r["s"] == "Groesse_Ueberschuss_EUR"
    assert r["s2"] == "CO2_O12" and r["k3"] == "Energy" and r["k4"] == "NLP"
    assert r["t"] == "abcde..."
    assert r["k"] == "Price" and r["k2"] == "NLP" and r["bl"] is True


def test_resolver_argmax_safe_div(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5], 1.0, 0.0)], "p array<double>, a double, b double")
    assert resolve_column(df, ["Spot Price", "p"]) == "p"
    assert resolve_column(df, ["x", "y"]) is None
    r = df.select(argmax_array("p").alias("i"), safe_div("a", "b").alias("d")).first()
    assert r["i"] == 1 and r["d"] is None
