"""Comparisons of two ranges and of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalar import confidence, deviation, deviation_reason, highlighted, numeric_change, ratio
from pulsegrid.operators.gaps import gap_stats

STATS = ("count", "window_hz", "observed_hz", "avg_gap_sec", "max_gap_sec", "jitter_sec")
#: Compared numbers of a profile. Fixed values.
METRICS = ("count", "duration_ns", "avg_gap_ns", "max_gap_ns", "jitter_ns", "expected_count_per_window", "finalized_window_count", "out_of_order_count", "late_dropped_count")
CONTEXT = ("sensor_category", "expected_count_source", "expected_hz")
EVIDENCE = ("selected_window_count", "max_score", "mean_score", "min_count_ratio", "max_gap_ns", "max_jitter_ns")


def two_sides(messages: DataFrame, normal: tuple[int, int], incident: tuple[int, int], keys: list[str]) -> DataFrame:
    """Statistics per keys of both ranges side by side (n_*, i_*), zeros where a side has no message; one shuffle with the side in the key."""
    t = F.col("log_time_ns")
    inside = [(t >= a) & (t < b) for a, b in (normal, incident)]
    sides = F.filter(F.array(*[F.when(c, F.lit(s)) for c, s in zip(inside, "ni")]), lambda s: s.isNotNull())
    rows = messages.where(inside[0] | inside[1]).withColumn("side", F.explode(sides))
    stats = gap_stats(rows, [*keys, "side"])
    span = F.when(F.col("side") == "n", (normal[1] - normal[0]) / 1e9).otherwise((incident[1] - incident[0]) / 1e9)
    stats = stats.withColumn("window_hz", F.col("count") / span)
    pick = lambda s, c: F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(0)).alias(f"{s}_{c}")
    return stats.groupBy(*keys).agg(*[pick(s, c) for s in "ni" for c in STATS])


def compare_topic(messages: DataFrame, topic: str, normal: tuple[int, int], incident: tuple[int, int]) -> DataFrame:
    """One topic in two ranges: a row per metric with both values and their ratio."""
    side = two_sides(messages.where(F.col("topic") == topic), normal, incident, ["topic"])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"n_{c}").cast("double").alias("normal"), F.col(f"i_{c}").cast("double").alias("incident")) for c in STATS]))
    return side.select("topic", rows.alias("r")).select("topic", "r.*", ratio("r.incident", "r.normal").alias("ratio"))


def compare_topics(messages: DataFrame, channels: DataFrame, normal: tuple[int, int], incident: tuple[int, int], keys: list[str]) -> DataFrame:
    """All topics of ``channels`` in two ranges: ratios, confidence, highlight, deviation and reason. Infinite deviations stay infinite."""
    out = channels.select(*keys).distinct().join(two_sides(messages, normal, incident, keys), keys, "left").na.fill(0)
    r = {c: ratio(f"i_{c}", f"n_{c}") for c in ("count", "max_gap_sec", "jitter_sec")}
    out = out.withColumns({f"{c.removesuffix('_sec')}_ratio": v for c, v in r.items()})
    named = {c: F.col(f"{c}_ratio") for c in ("count", "max_gap", "jitter")}
    return out.withColumns(
        {
            "confidence": confidence("n_count", "i_count"),
            "highlight": highlighted("count_ratio", "i_count") | highlighted("max_gap_ratio", F.lit(1)) | highlighted("jitter_ratio", F.lit(1)),
            "deviation": deviation("i_count", *named.values()),
            "reason": deviation_reason("n_count", "i_count", **named),
        }
    )


def topic_sides(reference: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Topics of both sides as common, reference_only or target_only."""
    a, b = reference.select(*keys).distinct().withColumn("_r", F.lit(1)), target.select(*keys).distinct().withColumn("_t", F.lit(1))
    side = F.when(F.col("_r").isNull(), "target_only").when(F.col("_t").isNull(), "reference_only").otherwise("common")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def evidence_summary(profile: DataFrame, ranked: DataFrame) -> DataFrame:
    """Selected windows per run and topic of a profile: how many, scores, least ratio, largest gap and jitter; nulls if there is none."""
    sums = ranked.groupBy("run_id", "topic").agg(F.count(F.lit(1)).alias("selected_window_count"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.min("count_ratio").alias("min_count_ratio"), F.max("max_gap_ns").alias("max_gap_ns"), F.max("jitter_ns").alias("max_jitter_ns"))
    return profile.select("run_id", "topic").join(sums, ["run_id", "topic"], "left").withColumn("selected_window_count", F.coalesce("selected_window_count", F.lit(0)))


def _long(rows: DataFrame, names, prefix: str, alias: str) -> DataFrame:
    here = [c for c in names if c in rows.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{prefix}.{c}").alias("field"), F.col(c).cast("double").alias(alias)) for c in here]))
    return rows.select("run_id", "topic", pairs.alias("p")).select("run_id", "topic", "p.*")


def compare_fields(pairs: DataFrame, profile: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """All numbers of common topics for each pair (reference_id, target_id): values, delta, ratio, state, changed.

    A value that only one side has is changed, but not comparable. All pairs are one job.
    """
    values = _long(profile, METRICS, "profile", "value")
    if summary is not None:
        values = values.union(_long(summary, EVIDENCE, "evidence", "value"))
    r = pairs.join(values.select(F.col("run_id").alias("reference_id"), "topic", "field", F.col("value").alias("reference")), "reference_id")
    both = r.join(values.select(F.col("run_id").alias("target_id"), "topic", "field", F.col("value").alias("target")), ["target_id", "topic", "field"])
    one_sided = F.col("reference").isNull() != F.col("target").isNull()
    return both.withColumn("c", numeric_change("reference", "target")).select("reference_id", "target_id", "topic", "field", "reference", "target", "c.delta", "c.ratio", "c.ratio_state", (~F.col("reference").eqNullSafe(F.col("target"))).alias("changed"), one_sided.alias("non_comparable"))


def compare_context(pairs: DataFrame, profile: DataFrame, names=CONTEXT) -> DataFrame:
    """Context of common topics, by equality alone; and first / last times, told apart without delta or ratio."""
    here = [c for c in (*names, "first_ns", "last_ns") if c in profile.columns]
    side = lambda who: profile.select(F.col("run_id").alias(f"{who}_id"), "topic", *[F.col(c).cast("string").alias(f"{who}_{c}") for c in here])
    both = pairs.join(side("reference"), "reference_id").join(side("target"), ["target_id", "topic"])
    rows = F.explode(F.array(*[F.struct(F.lit(("timestamps." if c.endswith("_ns") else "context.") + c).alias("field"), (~F.col(f"reference_{c}").eqNullSafe(F.col(f"target_{c}"))).alias("changed")) for c in here]))
    return both.select("reference_id", "target_id", "topic", rows.alias("r")).select("reference_id", "target_id", "topic", "r.*")


def changed_fields(fields: DataFrame) -> DataFrame:
    """The sorted changed fields of each pair and topic, of which there is a fixed number."""
    return fields.groupBy("reference_id", "target_id", "topic").agg(F.array_sort(F.collect_list(F.when(F.col("changed"), F.col("field")))).alias("changed_fields"))


def namespace_counts(fields: DataFrame) -> DataFrame:
    return fields.where("changed").groupBy("reference_id", "target_id", F.split_part("field", F.lit("."), F.lit(1)).alias("namespace")).agg(F.count(F.lit(1)).alias("changed"))


def comparison_summary(fields: DataFrame, sides: DataFrame) -> DataFrame:
    """Identical and changed topics per pair, by profile and evidence, and the sizes of the topic sets (``sides`` with the pair's ids)."""
    pair = ["reference_id", "target_id"]
    part = lambda p: F.count_if(F.col(p)).alias(f"{p}_changed"), lambda p: F.count_if(~F.col(p)).alias(f"{p}_identical")
    topics = fields.groupBy(*pair, "topic").agg(*[F.coalesce(F.bool_or(F.when(F.col("field").startswith(p), F.col("changed"))), F.lit(False)).alias(p) for p in ("profile", "evidence")])
    sums = topics.groupBy(*pair).agg(*[f(p) for p in ("profile", "evidence") for f in part])
    sizes = sides.groupBy(*pair).agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("common", "reference_only", "target_only")])
    return sizes.join(sums, pair, "left").na.fill(0)


def topic_set_mismatches(profile: DataFrame, windows: DataFrame) -> DataFrame:
    """Topics that only one of the two tables of a run has."""
    keys = ["run_id", "topic"]
    a, b = profile.select(*keys).distinct(), windows.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("code", F.lit("no_windows")).union(b.join(a, keys, "left_anti").withColumn("code", F.lit("no_profile")))


def metric_violations(profile: DataFrame, names=METRICS) -> DataFrame:
    """Metrics that are missing, negative or not finite."""
    here = [c for c in names if c in profile.columns]

    def code(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(v.isNull(), "missing").when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), "not_finite").when(v < 0, "negative")

    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), code(c).alias("code")) for c in here]))
    return profile.select("run_id", "topic", rows.alias("r")).select("run_id", "topic", "r.*").where("code is not null")
