"""Incremental hour-bucket pre-aggregate for the decayed topic counts (A1).

The reference reads its article file once; this is the streaming form of the same
first step: articles arriving as files are folded into (topic, ceiling hour) counts
with an event-time watermark, and the decayed look-back sums are then computed in
batch from the bucket table (``operators.decay.decayed_from_buckets``), whose size
is bounded by hours x topics.

Bucket ``h = ceil_hour(a)`` is the end of the 1-hour tumbling window of ``a - 1us``
(an article exactly on the hour belongs to that hour, as in the batch operator).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

EVENTS_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, "
                 "value double, props string")


def hourly_topic_buckets(stream: DataFrame, ts: str = "publishedAt", topic: str = "topic",
                         other_label: str | None = None, watermark: str = "2 hours") -> DataFrame:
    """Streaming (topic, h, n, n_on) with late data bounded by ``watermark``."""
    s = stream.filter(F.col(ts).isNotNull() & F.col(topic).isNotNull())
    if other_label is not None:
        s = s.filter(F.col(topic) != F.lit(other_label))
    s = s.withColumn("_ts", (F.col(ts) - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp_ltz"))
    s = s.withColumn("_on", F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz") == F.col(ts))
    g = (s.withWatermark("_ts", watermark)
          .groupBy(F.window("_ts", "1 hour"), F.col(topic).alias("topic"))
          .agg(F.count(F.lit(1)).alias("n"), F.count_if("_on").alias("n_on")))
    return g.select("topic", F.col("window.end").cast("timestamp_ntz").alias("h"), "n", "n_on")


def start_bucket_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, *,
                        file_glob: str = "events*.parquet", schema: str | StructType = EVENTS_SCHEMA, ts: str = "ts",
                        topic: str = "event_type", other_label: str | None = None,
                        once: bool = True) -> StreamingQuery:
    """File source -> bucket counts per micro-batch -> Parquet, one folder per batch.

    Counts add up, so a batch writes its own partial buckets and no article is ever late: history
    may arrive in any order and no window stays open at the end.  A batch that is run again
    after a failure overwrites its folder, which makes the sink exactly-once.
    ``checkpoint`` belongs to this one stream; ``read_buckets`` sums the batches."""
    from tidemark.operators.decay import from_hour_index, topic_buckets
    src = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
           .option("maxFilesPerTrigger", 64).parquet(source_dir))
    src = src.select(F.col(ts).alias("publishedAt"), F.col(topic).alias("topic"))

    def write(batch: DataFrame, number: int) -> None:
        buckets = topic_buckets(batch, other_label=other_label).withColumn("h", from_hour_index("hi"))
        buckets.select("topic", "h", "n", "n_on").write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")

    w = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()


def read_buckets(spark: SparkSession, sink_dir: str) -> DataFrame:
    """(topic, h, n, n_on) over all batches written so far."""
    return (spark.read.parquet(sink_dir).groupBy("topic", "h")
            .agg(F.sum("n").alias("n"), F.sum("n_on").alias("n_on")))
