"""Aligned windows: observed ones, gaps across them, missing intervals, dense ones with baselines, top-ranked evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalar import baseline_score, count_ratio, irregularity
from pulsegrid.operators.gaps import STITCHED, bucket_rows, gap_stats, integer_jitter, integer_mean, stitched
from pulsegrid.operators.keys import join, join_summary
from pulsegrid.operators.ordering import with_max_before
from pulsegrid.shared import stored

RUN, TOPIC = ["run_id"], ["run_id", "topic"]


def aligned(messages: DataFrame, window_ns: int) -> DataFrame:
    """Messages with their ``window``: counted from the first message of the run, over all topics."""
    start = messages.groupBy(*RUN).agg(F.min("log_time_ns").alias("run_start_ns"))
    at = (F.col("log_time_ns") - F.col("run_start_ns")).cast("decimal(20,0)")
    return join_summary(messages, start, RUN).withColumn("window", F.floor(at / F.lit(window_ns).cast("decimal(20,0)")).cast("bigint"))


def observed_windows(messages: DataFrame, window_ns: int) -> DataFrame:
    """Rows per run, topic and observed window with its in-window gaps, taken in arrival order."""
    rows = aligned(messages, window_ns)
    out = bucket_rows(rows, [*TOPIC, "run_start_ns"], F.col("window"), order=["arrival_seq"]).withColumnRenamed("bucket", "window")
    return out.withColumns({"start_ns": F.col("run_start_ns") + F.col("window") * window_ns, "jitter_ns": integer_jitter(F.col("gap_n"), F.col("gap_sum"), F.col("gap_sq"))}).withColumn("end_ns", F.col("start_ns") + window_ns)


def expected_counts(windows: DataFrame, window_sec: float, metadata: DataFrame | None = None, mode: str = "first_window") -> DataFrame:
    """``windows`` with expected_count: from the topic's stated rate (half-even, 1 at least), else its first window or median.

    ``metadata`` (topic, sensor_category, expected_hz) has a row per topic; Spark sends it if it is small.
    """
    if mode == "first_window":
        own = windows.groupBy(*TOPIC).agg(F.min_by("count", "window").alias("_own"))
    else:
        middle = selected(windows, TOPIC, ["count"], lambda n: F.floor((n - 1) / 2)).withColumnRenamed("count", "_low")
        middle = join(middle, selected(windows, TOPIC, ["count"], lambda n: F.floor(n / 2)).withColumnRenamed("count", "_high"), TOPIC)
        own = middle.select(*TOPIC, ((F.col("_low") + F.col("_high")) / 2).cast("bigint").alias("_own"))
    windows = join_summary(windows, own, TOPIC)  # a row a topic
    own = F.col("_own")
    if metadata is None:
        return windows.withColumn("expected_count", own).drop("_own")
    joined = windows.join(metadata.select("topic", "sensor_category", "expected_hz"), "topic", "left").withColumn("sensor_category", F.coalesce("sensor_category", F.lit("unknown")))
    return joined.withColumn("expected_count", F.when(F.col("expected_hz").isNotNull(), F.greatest(F.lit(1), F.bround(F.col("expected_hz") * window_sec).cast("bigint"))).otherwise(own)).drop("_own")


def run_profile(windows: DataFrame) -> DataFrame:
    """Per run and topic, from ``observed_windows``: counts, span, mean / largest gap and jitter in ns, gaps across windows included."""
    rows = windows.withColumnRenamed("window", "bucket")
    total = stitched(rows, TOPIC)
    n = rows.groupBy(*TOPIC).agg(F.count(F.lit(1)).alias("finalized_window_count"))
    return join(total, n, TOPIC).select(
        *TOPIC, "count", "first_ns", "last_ns", (F.col("last_ns") - F.col("first_ns")).alias("duration_ns"),
        integer_mean(F.col("gap_n"), F.col("gap_sum")).alias("avg_gap_ns"), F.col("gap_max").alias("max_gap_ns"), integer_jitter(F.col("gap_n"), F.col("gap_sum"), F.col("gap_sq")).alias("jitter_ns"), "finalized_window_count",
    )


def missing_intervals(windows: DataFrame) -> DataFrame:
    """Neighbouring observed windows with others between: gap, first missing id, next id, how many; empty ones are never made."""
    # neighbours within blocks of windows, then the last and the first ones of neighbouring blocks: both need one shuffle
    of = [*TOPIC, "_block"]
    placed = windows.select(*TOPIC, "window", "first_ns", "last_ns", "run_start_ns", F.floor(F.col("window") / F.lit(STITCHED).cast("decimal(20,0)")).cast("bigint").alias("_block"))
    before = lambda c, over: F.lag(c).over(over)
    own = Window.partitionBy(*of).orderBy("window")
    inside = placed.select(*TOPIC, "window", "first_ns", "run_start_ns", before("window", own).alias("before"), before("last_ns", own).alias("previous_observed_ns"))
    ends = placed.groupBy(*of).agg(F.min(F.struct("window", "first_ns", "run_start_ns")).alias("first"), F.max(F.struct("window", "last_ns")).alias("last"))
    ends = ends.withColumn("earlier", before("last", Window.partitionBy(*TOPIC).orderBy("_block")))
    rows = inside.union(ends.select(*TOPIC, "first.window", "first.first_ns", "first.run_start_ns", "earlier.window", "earlier.last_ns"))
    return rows.where(F.col("window") - F.col("before") > 1).select(
        *TOPIC, "run_start_ns", (F.col("first_ns") - F.col("previous_observed_ns")).alias("gap_ns"), (F.col("before") + 1).alias("first_missing"), F.col("window").alias("next_window"), (F.col("window") - F.col("before") - 1).alias("missing_window_count"), "previous_observed_ns", F.col("first_ns").alias("next_observed_ns"),
    )


def top_missing(intervals: DataFrame, k: int) -> DataFrame:
    order = [F.desc(c) for c in ("gap_ns", "first_missing", "next_window", "missing_window_count", "previous_observed_ns", "next_observed_ns")]
    return intervals.withColumn("rank", F.row_number().over(Window.partitionBy(*TOPIC).orderBy(*order))).where(F.col("rank") <= k)


def observed_evidence(windows: DataFrame) -> DataFrame:
    """Observed windows with their score; they need expected_count."""
    return windows.select(
        *TOPIC, "window", "count", "expected_count", count_ratio("count", "expected_count").alias("count_ratio"), F.col("gap_max").alias("max_gap_ns"), "jitter_ns", irregularity("count", "expected_count", "gap_max", "jitter_ns").alias("score"),
        F.lit("observed_window").alias("evidence_kind"), F.lit(0).cast("bigint").alias("missing_window_count"), F.lit(None).cast("bigint").alias("previous_observed_ns"), F.lit(None).cast("bigint").alias("next_observed_ns"),
    )


def missing_evidence(intervals: DataFrame, expected: DataFrame) -> DataFrame:
    """Missing intervals with their score, in the shape of observed windows; ``expected`` has a row per topic."""
    return join(intervals, expected, TOPIC).select(
        *TOPIC, F.col("first_missing").alias("window"), F.lit(0).cast("bigint").alias("count"), "expected_count", count_ratio(F.lit(0), "expected_count").alias("count_ratio"), F.col("gap_ns").alias("max_gap_ns"), F.lit(0).cast("bigint").alias("jitter_ns"), irregularity(F.lit(0), "expected_count", "gap_ns", F.lit(0)).alias("score"),
        F.lit("sparse_missing_interval").alias("evidence_kind"), "missing_window_count", "previous_observed_ns", "next_observed_ns",
    )


def evidence(windows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Observed windows and missing intervals in one shape, with score; ``windows`` needs expected_count."""
    expected = windows.groupBy(*TOPIC).agg(F.max("expected_count").alias("expected_count"))
    return observed_evidence(windows).unionByName(missing_evidence(intervals, expected))


def top_windows(pooled: DataFrame, k: int, keys: list[str] | None = None, score: str = "score", window: str = "window") -> DataFrame:
    """The ``k`` highest by score of each group, by window if they tie."""
    return pooled.withColumn("rank", F.row_number().over(Window.partitionBy(*(keys or TOPIC)).orderBy(F.desc(score), F.asc(window)))).where(F.col("rank") <= k)


def timing_report(messages: DataFrame, window_ns: int, k: int, metadata: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Profile and ranked evidence of every run and topic; the windows, which all parts read, are stored once."""
    windows = stored(expected_counts(observed_windows(messages, window_ns), window_ns / 1e9, metadata), "windows")
    ranked = top_windows(evidence(windows, top_missing(missing_intervals(windows), k).drop("rank")), k)
    return run_profile(windows), ranked


def run_summary(profile: DataFrame, disorder: DataFrame | None = None) -> DataFrame:
    """Messages and topics per run, with late and out-of-order totals if given."""
    out = profile.groupBy(*RUN).agg(F.sum("count").alias("total_messages"), F.count(F.lit(1)).alias("topics"))
    return out if disorder is None else join(out, disorder.groupBy(*RUN).agg(F.sum("late_count").alias("late"), F.sum("out_of_order_count").alias("out_of_order")), RUN, "left")


#: Windows that one row of a dense grid is dealt to before they are made one by one.
GRID = 4096


def grid(bounds: DataFrame, window_ns: int, keys: list[str]) -> DataFrame:
    """keys, window, start_ns and stop_ns of all windows from start_ns to end_ns of ``bounds``, the last one cut short.

    They are made in two steps, so that no row holds more than ``GRID`` of them.
    """
    n = ((F.col("end_ns") - F.col("start_ns")).cast("decimal(20,0)") + window_ns - 1) / F.lit(window_ns).cast("decimal(20,0)")
    whole = bounds.where("end_ns > start_ns").select(*keys, F.col("start_ns").alias("from_ns"), "end_ns", F.floor(n).cast("bigint").alias("n"))
    dealt = whole.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(GRID).cast("bigint")))).repartition("first", *keys)
    each = dealt.withColumn("window", F.explode(F.sequence("first", F.least(F.col("first") + GRID, "n") - 1)))
    return each.select(*keys, "window", (F.col("from_ns") + F.col("window") * window_ns).alias("start_ns"), F.least(F.col("from_ns") + (F.col("window") + 1) * window_ns, "end_ns").alias("stop_ns"))


def dense_windows(messages: DataFrame, bounds: DataFrame, window_ns: int, keys: list[str]) -> DataFrame:
    """All windows of each group from start_ns to end_ns of ``bounds``, the last one cut short, with gap statistics; empty ones hold zeros."""
    inside = join(messages, bounds.select(*keys, F.col("start_ns").alias("from_ns"), "end_ns"), keys).where("log_time_ns >= from_ns and log_time_ns < end_ns")
    placed = inside.withColumn("window", F.floor((F.col("log_time_ns") - F.col("from_ns")) / F.lit(window_ns).cast("decimal(20,0)")).cast("bigint"))
    stats = gap_stats(placed, [*keys, "window"]).drop("first_ns", "last_ns")
    out = join(grid(bounds, window_ns, keys), stats, [*keys, "window"], "left").na.fill(0, ["count", "span_sec", "observed_hz", "avg_gap_sec", "max_gap_sec", "jitter_sec"])
    return out.withColumn("duration_sec", (F.col("stop_ns") - F.col("start_ns")) / 1e9).withColumn("window_hz", F.col("count") / F.col("duration_sec"))


#: Cells that a range of values is cut into at a time, and distinct values of a cell that are put in order at once.
CELLS = 4096


def selected(rows: DataFrame, keys: list[str], values: list[str], rank) -> DataFrame:
    """Of each of ``values`` the one at place ``rank(n)`` of its n sorted values per keys (from 0), nulls left out.

    Equal values are counted first. While the cell that holds the place has more than ``CELLS`` distinct values, the
    range from its least to its largest value is cut into ``CELLS`` equal cells, which are counted; the cell that the
    place is in is next. Its bounds are values of its own, so each round cuts it, whatever the values' distribution.
    Only the last cell is put in order. No task holds a group, and the driver asks only whether a round is the last.
    """
    each = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values])).alias("x")).select(*keys, "x.name", "x.v").where("v is not null")
    of = [*keys, "name"]
    counted = stored(each.groupBy(*of, "v").agg(F.count(F.lit(1)).alias("n")), "counted-values")
    cell_of = [F.sum("n").alias("cell_n"), F.count(F.lit(1)).alias("distinct"), F.min("v").alias("low"), F.max("v").alias("high")]
    cell = stored(counted.groupBy(*of).agg(*cell_of).withColumn("left", rank(F.col("cell_n")).cast("bigint")).drop("cell_n"), "cells")
    while True:
        large = cell.where((F.col("distinct") > CELLS) & (F.col("low") < F.col("high")))
        if not large.head(1):
            break
        inside = join_summary(counted, large, of).where("v between low and high")
        # halves, as the range of all doubles is beyond the largest one
        part = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * CELLS), F.lit(CELLS - 1))
        cut = inside.select(*of, "v", "n", "left", part.alias("cell")).groupBy(*of, "left", "cell").agg(*cell_of)
        over = Window.partitionBy(*of).orderBy("cell")  # CELLS rows at most
        cut = cut.withColumn("upto", F.sum("cell_n").over(over)).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("cell_n") <= F.col("left")))
        cut = cut.select(*of, "distinct", "low", "high", (F.col("left") - F.col("upto") + F.col("cell_n")).alias("left"))
        small = cell.where(~((F.col("distinct") > CELLS) & (F.col("low") < F.col("high"))))
        cell = stored(small.select(*of, "distinct", "low", "high", "left").unionByName(cut), "cells")
    inside = join_summary(counted, cell, of).where("v between low and high").withColumn("upto", F.sum("n").over(Window.partitionBy(*of).orderBy("v")))
    found = inside.where(F.col("upto") > F.col("left")).groupBy(*of).agg(F.min("v").alias("v"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == v, F.col("v"))).alias(v) for v in values])


def upper_medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``sorted[n // 2]`` of each of ``values`` per keys, nulls left out."""
    return selected(rows, keys, values, lambda n: F.floor(n / 2))


def baseline_medians(dense: DataFrame, keys: list[str]) -> DataFrame:
    """Upper medians of count, largest gap and jitter over windows with two messages or more."""
    found = upper_medians(dense.where("count >= 2"), keys, ["count", "max_gap_sec", "jitter_sec"])
    return found.select(*keys, F.col("count").cast("bigint").alias("base_count"), F.col("max_gap_sec").alias("base_max_gap_sec"), F.col("jitter_sec").alias("base_jitter_sec"))


def full_windows(dense: DataFrame, window_sec: float) -> DataFrame:
    return dense.where(F.col("duration_sec") >= window_sec * 0.999)


def baseline_ranking(dense: DataFrame, window_sec: float, k: int, keys: list[str]) -> DataFrame:
    """Full windows by their distance from the group's medians, the ``k`` farthest."""
    scored = join(full_windows(dense, window_sec), baseline_medians(dense, keys), keys).withColumn("score", baseline_score("count", "max_gap_sec", "jitter_sec", "base_count", "base_max_gap_sec", "base_jitter_sec"))
    return top_windows(scored, k, keys)


def silent_together(ranked: DataFrame, windows: DataFrame) -> DataFrame:
    """What each other topic of the run did in the same window as each ranked one: its count, 0 where it was silent, and its expected count.

    ``windows`` needs expected_count (``expected_counts``); a silent topic's is the largest of its windows.
    """
    topics = windows.groupBy(*TOPIC).agg(F.max("expected_count").alias("usual")).withColumnRenamed("topic", "other_topic")
    pairs = join(ranked.select("run_id", "topic", "window", "rank"), topics, RUN).where(~F.col("topic").eqNullSafe(F.col("other_topic")))
    seen = windows.select("run_id", "window", F.col("topic").alias("other_topic"), F.col("count").alias("other_count"), "expected_count")
    out = join(pairs, seen, ["run_id", "window", "other_topic"], "left")
    return out.select("run_id", "topic", "window", "rank", "other_topic", F.coalesce("other_count", F.lit(0).cast("bigint")).alias("other_count"), F.coalesce("expected_count", "usual").alias("other_expected_count"))


def peak_open(messages: DataFrame, window_ns: int, lateness_ns: int) -> DataFrame:
    """Per run, the most windows that are open at once when messages are taken in arrival order.

    A window opens with its topic's first accepted message in it, and is finished by the first message of the run whose
    time is its end plus the lateness or more. ``messages`` are accepted ones (``ordering.accepted``).
    """
    placed = aligned(messages, window_ns)
    opens = placed.groupBy(*TOPIC, "window").agg(F.min("arrival_seq").alias("open_seq"), F.min(F.col("run_start_ns") + (F.col("window") + 1) * window_ns + lateness_ns).alias("until"))
    # the first arrival at or after a time: the least number among rows that come earlier in descending time
    rows = placed.select("run_id", (-2 * F.col("log_time_ns")).alias("_order"), (-F.col("arrival_seq")).alias("_seq"), F.lit(None).cast("bigint").alias("open_seq"))
    ends = opens.select("run_id", (-2 * F.col("until") + 1).alias("_order"), F.lit(None).cast("bigint").alias("_seq"), "open_seq")
    closed = with_max_before(rows.union(ends), RUN, "_seq", "_order", "_first", 2 * window_ns).where("open_seq is not null")
    steps = opens.select("run_id", F.col("open_seq").alias("at"), F.lit(1).alias("step")).union(closed.where("_first is not null").select("run_id", (-F.col("_first")).alias("at"), F.lit(-1).alias("step")))
    each = steps.groupBy("run_id", "at").agg(F.sum("step").alias("step"))  # two rows a window at most
    return each.withColumn("open", F.sum("step").over(Window.partitionBy(*RUN).orderBy("at"))).groupBy(*RUN).agg(F.max("open").alias("peak_open"))
