"""Canonical tables, and adapters that view other tables as them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS = 1_000_000_000

MESSAGES = "run_id string, topic string, log_time_ns bigint, publish_time_ns bigint, sequence bigint, channel_id int, schema_id int, message_size bigint, arrival_seq bigint"
TRACE_EVENTS = (
    "event_id string, sequence_index bigint, trace_id string, ros_time double, wall_time_utc string, clock_domain string, time_source string, "
    "event_type string, source_topic string, source_node string, event_hash string, prev_event_hash string, artifact_fingerprint string, event_summary map<string,string>"
)
TOPIC_METADATA = "topic string, sensor_category string, expected_hz double"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever zone the session has."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def messages_from_events(events: DataFrame, runs: int = 4) -> DataFrame:
    """The events table as messages: its type is the topic, its id the arrival order, ``user_id % runs`` the run."""
    ns = micros("ts") * 1000
    return events.select(
        F.concat(F.lit("r"), (F.col("user_id") % runs).cast("string")).alias("run_id"),
        F.col("event_type").alias("topic"),
        ns.alias("log_time_ns"),
        ns.alias("publish_time_ns"),
        F.col("event_id").alias("sequence"),
        F.lit(None).cast("int").alias("channel_id"),
        F.lit(None).cast("int").alias("schema_id"),
        F.length("props").cast("bigint").alias("message_size"),
        F.col("event_id").alias("arrival_seq"),
    )


def disordered(messages: DataFrame, every: int = 7, back_ns: int = 3 * 3600 * NS) -> DataFrame:
    """Messages of which every ``every``-th arrives ``back_ns`` late by its own time."""
    return messages.withColumn("log_time_ns", F.col("log_time_ns") - F.when(F.col("arrival_seq") % every == 0, back_ns).otherwise(0))


def trace_events_from_events(events: DataFrame) -> DataFrame:
    """The events table as hash-chained trace events."""
    name = lambda i: F.concat(F.lit("e"), i.cast("string"))
    digest = lambda i: F.sha2(name(i), 256)
    i = F.col("event_id")
    return events.select(
        name(i).alias("event_id"),
        i.alias("sequence_index"),
        F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("trace_id"),
        (micros("ts") / 1e6).alias("ros_time"),
        F.lit("ROS").alias("clock_domain"),
        F.lit("LOG").alias("time_source"),
        F.col("event_type"),
        F.concat(F.lit("/"), F.col("event_type")).alias("source_topic"),
        F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("source_node"),
        digest(i).alias("event_hash"),
        F.when(i > 0, digest(i - 1)).otherwise(F.repeat(F.lit("0"), 64)).alias("prev_event_hash"),
        F.col("props").alias("raw"),
    )
