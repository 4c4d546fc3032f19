"""Incident datasets against the mean rates of normal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalar import TINY, rate_reason, rate_score, safe_ratio

#: Words of a dataset's name and the topic that they stand for. Fixed values.
KEYWORDS = {"scan": "/scan", "lidar": "/scan", "laser": "/scan", "imu": "/imu", "odom": "/odom", "cmd": "/cmd_vel", "command": "/cmd_vel", "tf": "/tf"}
LEAST_HZ = 0.1


def topic_rates(datasets: DataFrame) -> DataFrame:
    """dataset_name, dataset_type, topic, message_count, duration_sec and hz (0 without duration), from the map ``topics``."""
    rows = datasets.select("dataset_name", "dataset_type", "duration_sec", F.explode("topics").alias("topic", "message_count"))
    return rows.withColumn("hz", F.when(F.col("duration_sec") > TINY, F.col("message_count") / F.when(F.col("duration_sec") > TINY, F.col("duration_sec"))).otherwise(0.0))


def mean_normal_rates(rates: DataFrame) -> DataFrame:
    return rates.where(F.col("dataset_type") == "normal").groupBy("topic").agg(F.avg("hz").alias("normal_hz"))


def candidates(rates: DataFrame, least_hz: float = LEAST_HZ, control_topics=("/cmd_vel",)) -> DataFrame:
    """Incident topics with their mean normal rate, unless both are low; topics that only normal datasets have are no candidates."""
    out = rates.where(F.col("dataset_type") == "incident").join(mean_normal_rates(rates), "topic", "left").withColumn("normal_hz", F.coalesce("normal_hz", F.lit(0.0)))
    out = out.where(F.greatest("normal_hz", "hz") >= least_hz)
    return out.withColumns({"score": rate_score("hz", "normal_hz"), "ratio": safe_ratio("hz", "normal_hz"), "reason": rate_reason("topic", "hz", "normal_hz", control_topics)})


def top_candidates(found: DataFrame) -> DataFrame:
    """The highest-scoring topic of each dataset, the first by name if they tie."""
    top = found.groupBy("dataset_name").agg(F.max("score").alias("top_score"))
    return found.join(top, "dataset_name").where("score = top_score").groupBy("dataset_name").agg(F.min(F.struct("topic", "score", "reason")).alias("r")).select("dataset_name", "r.*")


def expected_topic(datasets: DataFrame, keywords: dict[str, str] | None = None) -> DataFrame:
    """The topic that a dataset declares, else the only one that its name's words stand for, else AMBIGUOUS or NO_DECLARATION."""
    name = F.lower("dataset_name")
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(name.contains(k), t) for k, t in (keywords or KEYWORDS).items()])))
    declared = F.col("declared_topic").isNotNull() & (F.col("declared_topic") != "")
    out = datasets.select("dataset_name", "declared_topic", hits.alias("hits"))
    status = F.when(declared, "DECLARED").when(F.size("hits") == 0, "NO_DECLARATION").when(F.size("hits") > 1, "AMBIGUOUS").otherwise("INFERRED_FROM_NAME")
    return out.select("dataset_name", status.alias("status"), F.when(declared, F.col("declared_topic")).when(F.size("hits") == 1, F.get("hits", F.lit(0))).alias("expected_topic"))


def verify(datasets: DataFrame, least_hz: float = LEAST_HZ) -> DataFrame:
    """Per incident dataset: PASS if its top candidate is the expected topic, REVIEW if not, else the declaration's status."""
    top = top_candidates(candidates(topic_rates(datasets), least_hz))
    expected = expected_topic(datasets.where(F.col("dataset_type") == "incident"))
    out = expected.join(top, "dataset_name", "left")
    result = F.when(F.col("status").isin("AMBIGUOUS", "NO_DECLARATION"), F.col("status")).when(F.col("topic").eqNullSafe(F.col("expected_topic")), "PASS").otherwise("REVIEW")
    return out.select("dataset_name", "status", "expected_topic", F.col("topic").alias("top_topic"), "score", "reason", result.alias("result"))


def tallies(verified: DataFrame) -> DataFrame:
    return verified.groupBy("result").agg(F.count(F.lit(1)).alias("n"))
