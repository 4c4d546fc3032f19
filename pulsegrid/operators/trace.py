"""Trace events: counts, index summaries, neighbourhoods of seed events and focused chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ("event_type", "source_topic", "source_node", "clock_domain", "time_source")

#: Chain presets: radius, then limits of motion and perception events before and after. Fixed values.
PRESETS = {
    "minimal_context": (20, 2, 1, 4, 1),
    "command_motion_scan": (80, 3, 1, 10, 2),
    "motion_perception_context": (120, 8, 3, 12, 3),
    "wide_context": (250, 20, 5, 30, 5),
}
PRESET_COLUMNS = ("scan_radius", "prev_motion", "prev_perception", "next_motion", "next_perception")


def category_counts(events: DataFrame, categories=CATEGORIES) -> DataFrame:
    """Rows per category and name, in one pass over grouping sets."""
    which = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in categories])
    name = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c)) for c in categories])
    grouped = events.groupingSets([[F.col(c)] for c in categories], *[F.col(c) for c in categories])
    return grouped.agg(which.alias("category"), name.alias("name"), F.count(F.lit(1)).alias("n")).select("category", "name", "n")


def facets(hits: DataFrame, categories=CATEGORIES) -> DataFrame:
    """Category counts of search hits, most common first."""
    return category_counts(hits, categories).orderBy("category", F.desc("n"), "name")


def index_summary(events: DataFrame, gaps: DataFrame, bad: str | None = None) -> DataFrame:
    """Totals, bad records, gaps, range of ros_time and distinct names, in one row."""
    total = events.agg(
        F.count(F.lit(1)).alias("events"), (F.count_if(F.col(bad).isNotNull()) if bad else F.lit(0).cast("bigint")).alias("bad_records"), F.min("ros_time").alias("min_ros_time"), F.max("ros_time").alias("max_ros_time"),
        F.count_distinct("event_type").alias("event_types"), F.count_distinct("source_topic").alias("topics"), F.count_distinct("source_node").alias("nodes"),
    )
    return total.join(F.broadcast(gaps.agg(F.count(F.lit(1)).alias("gaps"))), how="cross")  # one row each


def with_preset(seeds: DataFrame, preset: str | None = None) -> DataFrame:
    """Seeds with the limits of a named preset, or of the one in their column ``preset``."""
    if preset is not None:
        return seeds.withColumns({c: F.lit(v) for c, v in zip(PRESET_COLUMNS, PRESETS[preset])})
    table = F.create_map(*[x for name, values in PRESETS.items() for x in (F.lit(name), F.array(*map(F.lit, values)))])
    return seeds.withColumns({c: table[F.col("preset")][i] for i, c in enumerate(PRESET_COLUMNS)})


def neighbourhood(seeds: DataFrame, events: DataFrame, radius: int, keep: list[str]) -> DataFrame:
    """Events within ``radius`` sequence numbers of each seed: a join on buckets of one radius, three per seed."""
    bucket = F.floor(F.col("sequence_index") / F.lit(radius).cast("decimal(20,0)")).cast("bigint")
    s = seeds.withColumnRenamed("sequence_index", "seed_seq").withColumn("bucket", F.floor(F.col("seed_seq") / F.lit(radius).cast("decimal(20,0)")).cast("bigint")).withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    e = events.select(*dict.fromkeys(["sequence_index", *keep]), bucket.alias("bucket"))
    return s.join(e, "bucket").where(F.abs(F.col("sequence_index") - F.col("seed_seq")) <= F.lit(radius)).drop("bucket")


def chains(seeds: DataFrame, events: DataFrame, preset: str = "minimal_context", motion: str = "MOTION_SUMMARY", perception: str = "PERCEPTION_SUMMARY", type_col: str = "event_type") -> DataFrame:
    """The nearest events of the two types before and after each seed, up to the preset's limits, and the seed itself."""
    near = neighbourhood(with_preset(seeds.select("seed_id", "sequence_index"), preset), events, PRESETS[preset][0], ["event_id", type_col])
    side = F.signum(F.col("sequence_index") - F.col("seed_seq")).cast("int")
    near = near.withColumn("side", side).where((F.col("side") == 0) | F.col(type_col).isin(motion, perception))
    k = F.row_number().over(Window.partitionBy("seed_id", "side", type_col).orderBy(F.abs(F.col("sequence_index") - F.col("seed_seq"))))
    limit = F.when(F.col("side") == 0, 1).when(F.col("side") < 0, F.when(F.col(type_col) == motion, F.col("prev_motion")).otherwise(F.col("prev_perception"))).otherwise(F.when(F.col(type_col) == motion, F.col("next_motion")).otherwise(F.col("next_perception")))
    return near.withColumn("k", k).where(F.col("k") <= limit).select("seed_id", "seed_seq", "event_id", "sequence_index", type_col, "side")


def chain_summary(seeds: DataFrame, events: DataFrame, radius: int, include_topics: list[str] | None = None) -> DataFrame:
    """Per seed: status (ok, seed_missing, seed_unnumbered, seed_topic_excluded), rows in radius, skipped by topic, before and after.

    ``seeds`` holds seed_id, an event_id.
    """
    known = seeds.join(events.select(F.col("event_id").alias("seed_id"), "sequence_index", F.col("source_topic").alias("seed_topic"), F.lit(True).alias("known")), "seed_id", "left")
    taken = F.col("source_topic").isin(include_topics) if include_topics else F.lit(True)
    near = neighbourhood(known.where("sequence_index is not null").select("seed_id", "sequence_index"), events, radius, ["source_topic"])
    sums = near.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("rows_in_radius"), F.count_if(~taken).alias("skipped_by_topic"),
        F.count_if(taken & (F.col("sequence_index") < F.col("seed_seq"))).alias("before"), F.count_if(taken & (F.col("sequence_index") > F.col("seed_seq"))).alias("after"),
    )
    outside = ~F.col("seed_topic").isin(include_topics) if include_topics else F.lit(False)
    status = F.when(F.col("known").isNull(), "seed_missing").when(F.col("sequence_index").isNull(), "seed_unnumbered").when(outside, "seed_topic_excluded").otherwise("ok")
    return known.join(sums, "seed_id", "left").select("seed_id", status.alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_in_radius", "skipped_by_topic", "before", "after")])
