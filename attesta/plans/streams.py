"""Registered queries that run as streams over the tables, each to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.plans.catalog import query
from attesta.streaming import sampling


@query("SELECT user_id AS video, event_id AS idx, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS place FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 24")
def stream_frame_sampling(spark, d):
    """Every third event of a user as it comes in, 24 at most; an event's number grows with its time."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/{{events.parquet}}")  # as a pattern, it may be a file or a folder
    order = F.timestamp_seconds(F.col("event_id") + 1_000_000_000)  # a stream's watermark begins at 1970
    frames = events.select(F.col("user_id").alias("video"), F.col("event_id").alias("idx"), order.alias("ts"))
    return sampling.run_to_end(sampling.sample_stream(frames, 3, lateness="0 seconds")).select("video", "idx", "place")
