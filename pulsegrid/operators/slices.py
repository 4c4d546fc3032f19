"""Slices by time, topic and chunk; their summaries; searches; shareable projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.keys import join

RAW_SUFFIXES = r"\.(bag|db3|mcap|sqlite3)$"


def time_slice(messages: DataFrame, start_ns: int | None = None, end_ns: int | None = None, topics: list[str] | None = None, time: str = "log_time_ns") -> DataFrame:
    """Messages with start <= time < end and one of the topics; a bound that is None is open."""
    out = messages
    if topics is not None:
        out = out.where(F.col("topic").isin(list(topics)))
    if start_ns is not None:
        out = out.where(F.col(time) >= F.lit(start_ns))
    return out if end_ns is None else out.where(F.col(time) < F.lit(end_ns))


def chunk_slice(messages: DataFrame, chunks: DataFrame, chunk_id) -> DataFrame:
    """Messages within the closed time range of one chunk, those of overlapping chunks included."""
    one = chunks.where(F.col("chunk_id") == chunk_id).select(F.col("message_start_ns").alias("_from"), F.col("message_end_ns").alias("_to"))
    return messages.join(F.broadcast(one), (F.col("log_time_ns") >= F.col("_from")) & (F.col("log_time_ns") <= F.col("_to"))).drop("_from", "_to")  # one row is sent


def overlapping_chunks(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each query (query_id, start_ns, end_ns) with the chunks whose closed range meets its own.

    A range of up to 2**k ns lies in two buckets of that size at most: k is its level. Two ranges meet in a bucket of
    the higher of their levels, so each side is dealt to the buckets of its own level, and to those above it for the
    other side's own ones. That is a hundred rows a range at most, however long it is; a pair counts in the bucket
    where the later range starts.
    """

    def dealt(rows: DataFrame, a: str, b: str, own: bool) -> DataFrame:
        level = F.length(F.bin(F.col(b) - F.col(a)))
        rows = rows.where(F.col(a) <= F.col(b)).withColumn("level", level if own else F.explode(F.sequence(level + int(a == "start_ns"), F.lit(62))))
        at = lambda c: F.expr(f"shiftright({c}, level)")
        return rows.withColumn("bucket", F.explode(F.array_distinct(F.array(at(a), at(b)))))

    q = queries.select("query_id", "start_ns", "end_ns")
    c = chunks.select("chunk_id", "message_start_ns", "message_end_ns")
    meet = (F.col("message_start_ns") <= F.col("end_ns")) & (F.col("message_end_ns") >= F.col("start_ns"))
    first = F.expr("shiftright(greatest(message_start_ns, start_ns), level)") == F.col("bucket")
    # of equal levels the first join has the pair, so above it the query goes to strictly higher ones
    parts = [dealt(q, "start_ns", "end_ns", own).join(dealt(c, "message_start_ns", "message_end_ns", not own), ["level", "bucket"]) for own in (True, False)]
    return parts[0].union(parts[1]).where(meet & first).drop("level", "bucket")


def search(events: DataFrame, event_type: str | None = None, topic: str | None = None, contains: str | None = None, raw: str = "raw") -> DataFrame:
    """Events that meet all stated predicates; the substring is looked for in the raw line."""
    out = events
    if contains is not None:
        out = out.where(F.col(raw).contains(contains))
    if event_type is not None:
        out = out.where(F.col("event_type") == event_type)
    return out if topic is None else out.where(F.col("source_topic") == topic)


def ranked_search(events: DataFrame, event_type: str | None = None, topic: str | None = None, contains: str | None = None, raw: str = "raw") -> DataFrame:
    """Events that meet at least one predicate, with how many they meet as ``match_count``."""
    tests = [c for c in (event_type is not None and F.col("event_type") == event_type, topic is not None and F.col("source_topic") == topic, contains is not None and F.col(raw).contains(contains)) if c is not False]
    met = sum((F.coalesce(c, F.lit(False)).cast("int") for c in tests), F.lit(0))
    return events.withColumn("match_count", met).where("match_count > 0")


def search_order(hits: DataFrame, by: str = "ros_time", limit: int | None = None) -> DataFrame:
    """By file (sequence), ros_time (missing ones last) or match_count (largest first)."""
    order = {"file": [F.asc("sequence_index")], "ros_time": [F.asc_nulls_last("ros_time"), F.asc("sequence_index")], "match_count": [F.desc("match_count"), F.asc("sequence_index")]}[by]
    out = hits.orderBy(*order)
    return out if limit is None else out.limit(limit)


def slice_summary(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Count, first and last message per keys; of equal times the arrival order decides."""
    at = F.struct("log_time_ns", "arrival_seq")
    return messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min(at).alias("a"), F.max(at).alias("z")).select(*keys, "count", F.col("a.log_time_ns").alias("first_ns"), F.col("a.arrival_seq").alias("first_seq"), F.col("z.log_time_ns").alias("last_ns"), F.col("z.arrival_seq").alias("last_seq"))


def no_result_reason(queries: DataFrame, bounds: DataFrame, chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """Why a query (query_id, topic?, start_ns, end_ns) has no hit: outside_range, no_chunk, topic_silent, sparse; else has_result."""
    overlaps = overlapping_chunks(queries, chunks).groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"))
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    out = queries.join(F.broadcast(bounds), how="cross").join(overlaps, "query_id", "left").join(found, "query_id", "left")  # bounds is one row
    return out.select(
        "query_id",
        F.when(F.col("hits") > 0, "has_result").when((F.col("end_ns") < F.col("file_start_ns")) | (F.col("start_ns") > F.col("file_end_ns")), "outside_range").when(F.col("chunks").isNull(), "no_chunk").when(F.col("topic").isNotNull(), "topic_silent").otherwise("sparse").alias("reason"),
    )


def missing_topics(requested: DataFrame, channels: DataFrame) -> DataFrame:
    return requested.join(channels.select("topic").distinct(), "topic", "left_anti")


def raw_log_violations(artifacts: DataFrame, manifest: str = "report_manifest.json") -> DataFrame:
    """Artifacts that are raw logs by their suffix, or the manifest itself."""
    code = F.when(F.lower("path").rlike(RAW_SUFFIXES), "raw_log").when(F.col("path") == manifest, "manifest")
    return artifacts.withColumn("violation", code).where("violation is not null")


SHAREABLE = ("run_id", "topic", "count", "first_ns", "last_ns", "duration_ns", "avg_gap_ns", "max_gap_ns", "jitter_ns", "expected_count_per_window", "finalized_window_count")


def shareable(profile: DataFrame) -> DataFrame:
    """Timing metadata only: an allow-list of columns."""
    return profile.select(*[c for c in SHAREABLE if c in profile.columns])


def evidence_window(messages: DataFrame, windows: DataFrame, span_ns: int) -> DataFrame:
    """Count, ratio, active and silent span of each stated window (window_id, topic, start_ns, expected_count), all ``span_ns`` long and aligned.

    Messages find their window by arithmetic; windows without messages stay; a null topic is one of its own.
    """
    seen = messages.select("topic", (F.floor(F.col("log_time_ns") / F.lit(span_ns).cast("decimal(20,0)")).cast("bigint") * span_ns).alias("start_ns"), "log_time_ns").groupBy("topic", "start_ns").agg(F.count(F.lit(1)).alias("n"), F.min("log_time_ns").alias("first_ns"), F.max("log_time_ns").alias("last_ns"))
    active = F.coalesce((F.col("last_ns") - F.col("first_ns")) / 1e9, F.lit(0.0))
    return join(windows, seen, ["topic", "start_ns"], "left").select(
        "window_id", "topic", "start_ns", F.coalesce("n", F.lit(0)).alias("observed_count"), "expected_count",
        F.when(F.col("expected_count") > 0, F.coalesce("n", F.lit(0)) / F.col("expected_count")).alias("count_ratio"),
        active.alias("active_span_sec"), F.greatest(F.lit(0.0), F.lit(span_ns / 1e9) - active).alias("silent_span_sec"), "first_ns", "last_ns",
        F.when(F.col("n").isNull(), "OBSERVED_EMPTY_WINDOW").otherwise("OBSERVED_WINDOW").alias("evidence_level"),
    )
