"""The timing report of a stream, exact whatever the micro-batches: lateness by run, open windows, top windows and gaps.

Each micro-batch is taken by the batch operators, spread over all tasks, and joined with a state of a few numbers per
run, topic and open window: the run's largest time, which all its topics see; partial aggregates of open windows, which
new messages of the window are merged into, with the gap at the seam; sums per topic of what is closed; and the top
``k`` windows and missing intervals so far. A window closes when the run's largest time is its end plus the lateness.
Messages must come in the order of their arrival numbers from one micro-batch to the next.

The run starts at its first arrival. Messages before that which aren't late are counted as ``before_start`` and have no
window. After the last message ``Report.finish`` gives what ``windows.timing_report`` gives for the accepted messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.gaps import STITCHED, bucket_rows, integer_jitter, integer_mean
from pulsegrid.operators.keys import join, join_summary
from pulsegrid.operators.ordering import with_max_before, with_previous
from pulsegrid.operators.windows import RUN, TOPIC, missing_evidence, observed_evidence, top_missing, top_windows
from pulsegrid.shared import stored
from pulsegrid.streaming.versions import Versions, each_version

_KEYS = "run_id string, topic string"
RUNS = "run_id string, start_ns bigint, run_max_ns bigint"
COUNTS = f"{_KEYS}, received bigint, late_count bigint, out_of_order_count bigint, before_start_count bigint, topic_max_ns bigint"
GAPS = "gap_n bigint, gap_sum decimal(38,0), gap_sq decimal(38,0), gap_max bigint"
OPEN = f"{_KEYS}, run_start_ns bigint, window bigint, count bigint, first_ns bigint, last_ns bigint, {GAPS}, first_arrival_ns bigint, last_arrival_ns bigint"
CLOSED = f"{_KEYS}, count bigint, first_ns bigint, last_ns bigint, {GAPS}, finalized_window_count bigint, first_window bigint, expected_count bigint, last_window bigint, last_window_ns bigint"
TOP = f"{_KEYS}, window bigint, count bigint, expected_count bigint, count_ratio double, max_gap_ns bigint, jitter_ns bigint, score double, evidence_kind string, missing_window_count bigint, previous_observed_ns bigint, next_observed_ns bigint"
MISSING = f"{_KEYS}, run_start_ns bigint, gap_ns bigint, first_missing bigint, next_window bigint, missing_window_count bigint, previous_observed_ns bigint, next_observed_ns bigint"
WINDOWS = f"{_KEYS}, window bigint, start_ns bigint, end_ns bigint, count bigint, first_ns bigint, last_ns bigint, gap_max bigint, jitter_ns bigint, expected_count bigint"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def shaped(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(c.split(" ", 1)[0]).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in schema.split(", ")])


def _sums(rows: DataFrame, keys: list[str], sums: list[str], least: list[str] = (), most: list[str] = (), *more) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most], *more)


def marked(batch: DataFrame, runs: DataFrame, counts: DataFrame, lateness_ns: int) -> DataFrame:
    """A micro-batch with late, out_of_order and before_start, given what came before it; as ``ordering.disorder``."""
    rows = with_max_before(batch, RUN, "log_time_ns", "arrival_seq", "_batch_max")
    rows = join_summary(rows, runs.select("run_id", F.col("start_ns").alias("run_start_ns"), F.col("seen_ns").alias("_seen")), RUN)
    late = F.coalesce(F.col("log_time_ns") < F.greatest("_batch_max", "_seen") - lateness_ns, F.lit(False))
    rows = rows.withColumn("late", late).withColumn("_accepted", F.when(~F.col("late"), F.col("log_time_ns")))
    rows = with_max_before(rows, TOPIC, "_accepted", "arrival_seq", "_topic")
    # a topic that is new has no row there
    seen = join(rows.select(*TOPIC).distinct(), counts.select(*TOPIC, F.col("topic_max_ns").alias("_top")), TOPIC, "left")
    rows = join_summary(rows, seen, TOPIC)
    return rows.withColumns({"out_of_order": F.coalesce(F.col("log_time_ns") < F.greatest("_topic", "_top"), F.lit(False)), "before_start": ~F.col("late") & (F.col("log_time_ns") < F.col("run_start_ns"))}).drop("_batch_max", "_seen", "_topic", "_top")


class Report:
    """The report of a stream of messages, in tables below ``folder``."""

    def __init__(self, versions: Versions, window_ns: int, lateness_ns: int, k: int):
        self.v, self.window_ns, self.lateness_ns, self.k = versions, window_ns, lateness_ns, k

    def _runs(self, batch: DataFrame, before: DataFrame) -> DataFrame:
        """Runs with their start, their largest time before the micro-batch (seen_ns), and with it."""
        arrival = F.struct(F.col("arrival_seq").isNotNull(), "arrival_seq", "log_time_ns")
        new = batch.groupBy(*RUN).agg(F.min(arrival).alias("a"), F.max("log_time_ns").alias("run_max_ns")).select("run_id", F.lit(1).alias("part"), F.col("a.log_time_ns").alias("start_ns"), "run_max_ns")
        both = before.select("run_id", F.lit(0).alias("part"), "start_ns", "run_max_ns").union(new)
        return both.groupBy(*RUN).agg(F.min_by("start_ns", "part").alias("start_ns"), F.max("run_max_ns").alias("run_max_ns"), F.max(F.when(F.col("part") == 0, F.col("run_max_ns"))).alias("seen_ns"))

    def _merged(self, open_before: DataFrame, rows: DataFrame) -> DataFrame:
        """Open windows with the micro-batch's messages, and the gap where these begin."""
        at = (F.col("log_time_ns") - F.col("run_start_ns")).cast("decimal(20,0)")
        placed = rows.where("not late and not before_start").withColumn("window", F.floor(at / F.lit(self.window_ns).cast("decimal(20,0)")).cast("bigint"))
        parts = bucket_rows(placed, [*TOPIC, "run_start_ns"], F.col("window"), order=["arrival_seq", "log_time_ns"], arrivals=True).withColumnRenamed("bucket", "window")
        both = open_before.withColumn("part", F.lit(0)).unionByName(shaped(parts, OPEN).withColumn("part", F.lit(1)))
        end = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
        seam = (end(1, "first_arrival_ns") - end(0, "last_arrival_ns")).alias("seam")
        merged = _sums(both, [*TOPIC, "run_start_ns", "window"], ["count", "gap_n", "gap_sum", "gap_sq"], ["first_ns"], ["last_ns", "gap_max"], F.min_by("first_arrival_ns", "part").alias("first_arrival_ns"), F.max_by("last_arrival_ns", "part").alias("last_arrival_ns"), seam)
        wide, some = F.col("seam").cast("decimal(19,0)"), F.coalesce(F.col("seam") >= 0, F.lit(False))
        add = lambda c, x: F.col(c) + F.when(some, x).otherwise(F.lit(0))
        merged = merged.withColumns({"gap_n": add("gap_n", F.lit(1)), "gap_sum": add("gap_sum", wide), "gap_sq": add("gap_sq", (wide * wide).cast("decimal(38,0)")), "gap_max": F.greatest("gap_max", F.when(some, F.col("seam")).otherwise(F.lit(0)))})
        return shaped(merged, OPEN)

    def _closing(self, done: DataFrame, state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """What windows that close add to the topics' sums, the top windows and the top missing intervals."""
        done = done.withColumn("jitter_ns", integer_jitter(F.col("gap_n"), F.col("gap_sum"), F.col("gap_sq")))
        rows = with_previous(done, TOPIC, "window", ["window", "last_ns"], STITCHED)
        topics = join(done.select(*TOPIC).distinct(), state["closed"].select(*TOPIC, F.col("last_window").alias("_window"), F.col("last_window_ns").alias("_ns")), TOPIC, "left")
        rows = stored(join_summary(rows, topics, TOPIC).withColumns({"before": F.coalesce("previous.window", "_window"), "previous_observed_ns": F.coalesce("previous.last_ns", "_ns")}).drop("previous", "_window", "_ns"), "closed-windows")
        between = F.col("first_ns") - F.col("previous_observed_ns")
        rows = rows.withColumn("between", F.when(between >= 0, between))
        wide = F.col("between").cast("decimal(19,0)")
        new = rows.groupBy(*TOPIC).agg(
            F.sum("count").alias("count"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), (F.sum("gap_n") + F.count("between")).alias("gap_n"), (F.sum("gap_sum") + F.coalesce(F.sum(wide), F.lit(0))).alias("gap_sum"),
            (F.sum("gap_sq") + F.coalesce(F.sum((wide * wide).cast("decimal(38,0)")), F.lit(0))).alias("gap_sq"), F.greatest(F.max("gap_max"), F.coalesce(F.max("between"), F.lit(0))).alias("gap_max"), F.count(F.lit(1)).alias("finalized_window_count"),
            F.min("window").alias("first_window"), F.min_by("count", "window").alias("expected_count"), F.max("window").alias("last_window"), F.max_by("last_ns", "window").alias("last_window_ns"),
        )
        both = state["closed"].unionByName(shaped(new, CLOSED))
        ends = [F.min("first_window").alias("first_window"), F.min_by("expected_count", "first_window").alias("expected_count"), F.max("last_window").alias("last_window"), F.max_by("last_window_ns", "last_window").alias("last_window_ns")]
        closed = stored(shaped(_sums(both, TOPIC, ["count", "gap_n", "gap_sum", "gap_sq", "finalized_window_count"], ["first_ns"], ["last_ns", "gap_max"], *ends), CLOSED), "closed-topics")
        full = join_summary(rows, closed.select(*TOPIC, "expected_count"), TOPIC)
        top = top_windows(state["top"].unionByName(shaped(observed_evidence(full), TOP)), self.k).drop("rank")
        gaps = rows.where(F.col("window") - F.col("before") > 1).select(*TOPIC, "run_start_ns", (F.col("first_ns") - F.col("previous_observed_ns")).alias("gap_ns"), (F.col("before") + 1).alias("first_missing"), F.col("window").alias("next_window"), (F.col("window") - F.col("before") - 1).alias("missing_window_count"), "previous_observed_ns", F.col("first_ns").alias("next_observed_ns"))
        missing = top_missing(state["missing"].unionByName(gaps), self.k).drop("rank")
        windows = full.withColumns({"start_ns": F.col("run_start_ns") + F.col("window") * self.window_ns, "end_ns": F.col("run_start_ns") + (F.col("window") + 1) * self.window_ns})
        return {"closed": closed, "top": shaped(top, TOP), "missing": shaped(missing, MISSING), "windows": shaped(windows, WINDOWS)}

    def _state(self, number: int) -> dict[str, DataFrame]:
        return {name: self.v.read(name, schema, number) for name, schema in (("runs", RUNS), ("counts", COUNTS), ("open", OPEN), ("closed", CLOSED), ("top", TOP), ("missing", MISSING))}

    def step(self, batch: DataFrame, number: int) -> None:
        state = self._state(number - 1)
        runs = stored(self._runs(batch, state["runs"]), "runs")
        rows = stored(marked(batch, runs, state["counts"], self.lateness_ns), "marked")
        new = rows.groupBy(*TOPIC).agg(F.count(F.lit(1)).alias("received"), F.count_if("late").alias("late_count"), F.count_if("out_of_order").alias("out_of_order_count"), F.count_if("before_start").alias("before_start_count"), F.max("_accepted").alias("topic_max_ns"))
        counts = _sums(state["counts"].union(new), TOPIC, ["received", "late_count", "out_of_order_count", "before_start_count"], [], ["topic_max_ns"])
        merged = join_summary(stored(self._merged(state["open"], rows), "windows"), runs.select("run_id", "run_max_ns"), RUN)
        closes = F.col("run_start_ns") + (F.col("window") + 1) * self.window_ns <= F.col("run_max_ns") - self.lateness_ns
        for name, df in self._closing(merged.where(closes).drop("run_max_ns"), state).items():
            self.v.write(df, name, number)
        self.v.write(shaped(merged.where(~closes), OPEN), "open", number)
        self.v.write(shaped(runs, RUNS), "runs", number)
        self.v.write(shaped(counts, COUNTS), "counts", number)

    def run(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Keep the report of a stream with run_id, topic, log_time_ns and arrival_seq."""
        return each_version(messages.select("run_id", "topic", "log_time_ns", "arrival_seq"), self.v, checkpoint, self.step, **trigger)

    def counts(self) -> DataFrame:
        """Per run and topic, messages so far: received, late, out of order, before the run's start."""
        return self.v.read("counts", COUNTS, self.v.last()).drop("topic_max_ns")

    def windows(self) -> DataFrame:
        """All windows that are closed."""
        return self.v.added("windows", WINDOWS)

    def finish(self) -> tuple[DataFrame, DataFrame]:
        """Profile and ranked evidence as if the stream ended here; its state stays as it is."""
        state = self._state(self.v.last())
        found = self._closing(state["open"], state)
        profile = found["closed"].select(
            *TOPIC, "count", "first_ns", "last_ns", (F.col("last_ns") - F.col("first_ns")).alias("duration_ns"), integer_mean(F.col("gap_n"), F.col("gap_sum")).alias("avg_gap_ns"), F.col("gap_max").alias("max_gap_ns"),
            integer_jitter(F.col("gap_n"), F.col("gap_sum"), F.col("gap_sq")).alias("jitter_ns"), "finalized_window_count",
        )
        pooled = found["top"].unionByName(missing_evidence(found["missing"], found["closed"].select(*TOPIC, "expected_count")))
        return profile, top_windows(pooled, self.k)
