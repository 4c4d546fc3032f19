"""Compatibility of runs: fields that must be present, valid and equal, and fields whose difference is only a warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocking fields and the kind of their values. Fixed values.
BLOCKING = {
    "schema_name": "text",
    "schema_version": "text",
    "bundle_schema.name": "text",
    "bundle_schema.version": "text",
    "engine.name": "text",
    "extraction.semantics": "text",
    "extraction.mode": "text",
    "extraction.timestamp_unit": "text",
    "extraction.window_sec": "positive",
    "extraction.allowed_lateness_sec": "non_negative",
    "extraction.top": "positive_integer",
}
WARNING = ("engine.version", "source.format")


def _valid(field: str, kind: str) -> Column:
    c = F.col(field)
    if kind == "text":
        return F.length(F.trim(c.cast("string"))) > 0
    number = c.cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return finite & {"positive": number > 0, "non_negative": number >= 0, "positive_integer": (number > 0) & (number == F.floor(number))}[kind]


def fields(runs: DataFrame) -> DataFrame:
    """run_id, field, kind, value (numbers as doubles, so that 1 equals 1.0) and valid."""
    text = lambda f, kind: F.col(f).cast("string") if kind == "text" else F.col(f).cast("double").cast("string")
    rows = [F.struct(F.lit(f).alias("field"), F.lit("blocking").alias("level"), text(f, k).alias("value"), F.coalesce(_valid(f, k), F.lit(False)).alias("valid")) for f, k in BLOCKING.items()]
    rows += [F.struct(F.lit(f).alias("field"), F.lit("warning").alias("level"), F.col(f).cast("string").alias("value"), F.lit(True).alias("valid")) for f in WARNING]
    return runs.select("run_id", F.explode(F.array(*rows)).alias("f")).select("run_id", "f.*")


def checks(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """A row per pair (reference_id, target_id) and field: match, mismatch, missing or invalid; all pairs in one job."""
    values = fields(runs)
    side = lambda who: values.select(F.col("run_id").alias(f"{who}_id"), "field", "level", F.col("value").alias(f"{who}_value"), F.col("valid").alias(f"{who}_valid"))
    both = pairs.join(side("reference"), "reference_id").join(side("target").drop("level"), ["target_id", "field"])
    missing = F.col("reference_value").isNull() | F.col("target_value").isNull()
    state = F.when(missing & (F.col("level") == "blocking"), "missing").when(~F.col("reference_valid") | ~F.col("target_valid"), "invalid").when(F.col("reference_value").eqNullSafe(F.col("target_value")), "match").otherwise("mismatch")
    return both.select("reference_id", "target_id", "field", "level", state.alias("state"))


def compatibility(checked: DataFrame) -> DataFrame:
    """Per pair: compatible if all blocking fields match; how many block, how many warn."""
    bad = F.col("state") != "match"
    out = checked.groupBy("reference_id", "target_id").agg(F.count_if(bad & (F.col("level") == "blocking")).alias("blocking"), F.count_if(bad & (F.col("level") == "warning")).alias("warnings"))
    return out.withColumn("compatible", F.col("blocking") == 0)


def provenance(runs: DataFrame, profile: DataFrame) -> DataFrame:
    """What each run says of where it comes from, missing parts null, with its number of topics."""
    topics = profile.groupBy("run_id").agg(F.count_distinct("topic").alias("topic_count"))
    pick = lambda part, *names: F.struct(*[F.col(f"{part}.{n}").alias(n) for n in names]).alias(part)
    out = runs.select("run_id", "report_bundle_id", "generated_at", pick("bundle_schema", "name", "version"), pick("engine", "name", "version"), pick("source", "format", "file_name", "file_size_bytes"), "extraction", F.col("extraction.total_messages_observed").alias("total_messages_observed"))
    return out.join(topics, "run_id", "left").na.fill(0, ["topic_count"])
