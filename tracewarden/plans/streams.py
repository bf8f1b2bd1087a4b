"""Streaming queries: the file source drives each to completion; results equal those of the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.plans.registry import query
from tracewarden.session import work_dir
from tracewarden.sources.tables import table
from tracewarden.streaming import streams


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return streams.table_source(spark, folder, "events", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _done(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over all input and returns what it last published."""
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = streams.published(stream, f"{base}/out", f"{base}/state", mode)
    q.awaitTermination()
    out = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
    if mode == "complete":  # every batch holds the whole result: the last one counts
        last = spark.read.parquet(f"{base}/out").agg(F.max("batch")).scalar()
        out = spark.read.parquet(f"{base}/out").where(F.col("batch") == last).drop("batch")
    return out


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS bin_us, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    out = _done(spark, streams.tumbling(_events(spark, d), "ts", ["event_type"], "value", "6 hours", "1 day"), "complete")
    return out.select(F.unix_micros("bin").alias("bin_us"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), s AS (SELECT user_id, us, sum(CASE WHEN us - p < 86400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us)::BIGINT AS run FROM (SELECT user_id, us, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS p FROM e)) SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY user_id, run")
def stream_session(spark, d):
    out = _done(spark, streams.sessions(_events(spark, d), "ts", ["user_id"], "24 hours", "1 day"), "complete")
    return out.select("user_id", F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"), "n")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_dedup(spark, d):
    """The first of each pair. The watermark remembers a pair for 60 days: the table spans 30, so its twin needs no such limit."""
    stream = streams.first_only(_events(spark, d), "ts", ["user_id", "event_type"], "60 days")
    return _done(spark, stream.select("user_id", "event_type"), "append")


@query("WITH w AS (SELECT event_type, value, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS b FROM events), x AS (SELECT event_type, value, unnest([b, b - 21600000000]) AS start_us FROM w) SELECT start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak FROM x GROUP BY 1, 2")
def stream_sliding(spark, d):
    """Baselines of twelve hours, a new one every six."""
    out = _done(spark, streams.sliding(_events(spark, d), "ts", ["event_type"], "value", "12 hours", "6 hours", "1 day"), "complete")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("mean", 6).alias("mean"), "peak")


@query()
def stream_memory(spark, d):
    """Online memory by label over the vectors as a stream."""
    rows = streams.table_source(spark, d, "embeddings", table(spark, d, "embeddings").schema)
    return _done(spark, streams.memory(rows, "label", "vec_id", "embedding", 0.5), "append")
