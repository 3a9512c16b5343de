"""Sources, sinks and the streaming bucket pre-aggregate."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.operators import decay
from tidemark.sources import news as S
from tidemark.sources import tables as T
from tidemark.streaming import hourly


def _tmp():
    return tempfile.mkdtemp(prefix="tidemark-test-")


def test_news_csv_roundtrip_and_batches(spark):
    """Write the news stand-in as daily CSV batches with an extra column
    and a malformed line, read them back by header name."""
    d = _tmp()
    n = T.news(spark, SF_SMALL).withColumn("publishedAt", F.date_format("publishedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    n = n.withColumn("extra", F.lit("x"))
    paths = []
    for day in (1, 2):
        p = os.path.join(d, f"batch{day}")
        S.write_csv(n.filter(F.dayofmonth(F.to_timestamp("publishedAt")) == day)
                    .select("publishedAt", "title", "source", "description", "url", "extra"), p)
        paths.append(p)
    got = S.merge_batches(spark, paths)
    want = T.news(spark, SF_SMALL).filter(F.dayofmonth("publishedAt").isin(1, 2))
    assert got.count() == want.count()
    g = {r["url"]: r["publishedAt"] for r in got.collect()}
    w = {r["url"]: r["publishedAt"] for r in want.collect()}
    assert g == w
    assert got.select(F.countDistinct("batch_file")).first()[0] >= 2


def test_csv_rows_with_wrong_field_counts(spark):
    """A row with too many fields is skipped, a short one padded."""
    d = _tmp()
    with open(os.path.join(d, "n.csv"), "w") as fh:
        fh.write("publishedAt,title,source,description,url\n2024-01-01T10:00:00Z,a,s,d,u\n"
                 "2024-01-01T10:00:00Z,b,s,d,u,extra\n2024-01-01T11:00:00Z,c,s\n")
    got = {r["title"]: r for r in S.read_news_csv(spark, d).collect()}
    assert set(got) == {"a", "c"} and got["c"]["url"] is None and got["c"]["source"] == "s"


def test_news_json_flatten(spark):
    """Nested records with missing fields get the fetcher's defaults."""
    d = _tmp()
    recs = [{"publishedAt": "2024-01-02T10:00:00Z", "title": "A", "source": {"id": None, "name": "s1"},
             "description": "d", "url": "u"},
            {"publishedAt": "2024-01-02T11:30:00+01:00", "source": {"name": "s2"}}]
    with open(os.path.join(d, "a.json"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in recs))
    rows = sorted(S.read_news_json(spark, d).collect(), key=lambda r: r["source"])
    assert rows[0]["title"] == "A" and rows[0]["publishedAt"] == dt.datetime(2024, 1, 2, 10, 0)
    assert rows[1]["title"] == "" and rows[1]["description"] == "" and rows[1]["url"] == ""
    assert rows[1]["publishedAt"] == dt.datetime(2024, 1, 2, 11, 30)


def test_energy_csv_shift_and_drop(spark):
    """Timestamps move back one hour, Nuclear is dropped."""
    d = _tmp()
    with open(os.path.join(d, "e.csv"), "w") as fh:
        fh.write("Timestamp,Spot Price,Day Ahead Auction,Load,Nuclear,Renewable\n2024-01-01 01:00:00,10,8,100,5,6\n")
    r = S.read_energy_csv(spark, d).collect()[0]
    assert r["Timestamp"] == dt.datetime(2024, 1, 1, 0, 0)
    assert "Nuclear" not in r.asDict() and "Renewable" not in r.asDict() and r["Spot Price"] == 10.0


def test_stream_buckets_equal_batch(spark):
    """Streaming bucket aggregate == batch buckets; decayed counts from streamed
    buckets == batch A1."""
    sink, ck = _tmp(), _tmp()
    q = hourly.start_bucket_stream(spark, SF_SMALL, sink, ck, file_glob="events.parquet",
                                   other_label=T.OTHER_TOPIC_EVENTS, once=True)
    q.awaitTermination(300)
    streamed = hourly.read_buckets(spark, sink)
    batch = decay.topic_buckets(T.topic_news(spark, SF_SMALL), other_label=T.OTHER_TOPIC_EVENTS) \
        .withColumn("h", decay.from_hour_index("hi"))
    s = {(r["topic"], r["h"]): (r["n"], r["n_on"]) for r in streamed.collect()}
    b = {(r["topic"], r["h"]): (r["n"], r["n_on"]) for r in batch.collect()}
    assert s == b
    from tidemark.plans.ingest import master_table
    m = master_table(T.energy_hourly(spark, SF_SMALL))
    full = decay.decayed_from_buckets(batch.drop("h"), m, 336, 0.05)
    from_stream = decay.decayed_from_buckets(streamed, m, 336, 0.05)
    assert from_stream.count() > 0
    ref = decay.decayed_topic_counts(T.topic_news(spark, SF_SMALL), m, 336, 0.05, other_label=T.OTHER_TOPIC_EVENTS)
    assert full.exceptAll(ref).count() == 0 and ref.exceptAll(full).count() == 0


def test_artifacts_roundtrip(spark):
    """Save models + manifest + test split, load them back."""
    from tidemark.operators import learners
    df = spark.createDataFrame([(float(i % 3), float(i), float(i % 5)) for i in range(60)], "label double, a double, b double")
    m = learners.fit_forest(df, ["a", "b"], {"numTrees": 5, "maxDepth": 2, "subsamplingRate": 0.8,
                                              "minInstancesPerNode": 1, "featureSubsetFraction": 0.9})
    d = _tmp()
    man = learners.save_artifacts(d, {"forest": m}, {"features": ["a", "b"], "note": "x"}, spark, df)
    got = learners.load_artifacts(d, spark)
    assert got["manifest"]["features"] == ["a", "b"] and got["test_df"].count() == 60
    inputs, names = learners.scoring_inputs(got, id_cols=(), target="label")
    assert inputs.columns == ["label", "a", "b"] and names == ["a", "b"]
    assert "models" not in learners.load_artifacts(d, spark, load_models=False, load_test_data=False)
    assert got["models"]["forest"].numFeatures == 2 and man["models"]["forest"].endswith("model_forest")


def test_fingerprint_cache(spark):
    """Same content + params -> same folder is reused."""
    from tidemark.operators import vectors
    e = T.embedded_news(spark, SF_SMALL)
    d = _tmp()
    a = vectors.cached_parquet(e, d, {"k": 1})
    b = vectors.cached_parquet(e, d, {"k": 1})
    assert a.inputFiles() == b.inputFiles()
    # other vectors under the same ids, or a folder without a finished write, are not reused
    other = vectors.cached_parquet(e.withColumn("embedding", F.reverse("embedding")), d, {"k": 1})
    assert other.inputFiles() != a.inputFiles()
    folder = os.path.join(d, next(f for f in os.listdir(d) if a.inputFiles()[0].split("/")[-2] == f))
    os.rename(os.path.join(folder, "_SUCCESS"), os.path.join(folder, "_HALF"))
    assert not vectors._written(spark, folder) and vectors.cached_parquet(e, d, {"k": 1}).count() == e.count()
    a = spark.read.parquet(folder)
    assert vectors.dataset_fingerprint(e, ["article_id"]) == vectors.dataset_fingerprint(e.orderBy(F.rand(1)), ["article_id"])
    assert a.count() == e.count()
