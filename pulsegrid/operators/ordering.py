"""Arrival order: running maxima, late and out-of-order rows, sequence gaps, append checks, runs laid end to end.

What a row needs to know of all rows before it is found in two levels: within blocks of consecutive arrival numbers,
and over one row per block. No window holds a whole run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.keys import join

BLOCK = 65_536


#: Rows without a number stand in blocks of their values: of an hour, if these are times.
UNNUMBERED_BLOCK = 3_600_000_000_000


def with_max_before(rows: DataFrame, keys: list[str], value: str, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with the largest ``value`` of all earlier rows of the keys, by ``order`` (an integer column), then by value.

    Rows without a number come first, in the order of their values.
    """
    at = lambda c, n: F.floor(F.col(c) / F.lit(n).cast("decimal(20,0)")).cast("bigint")
    rows = rows.withColumn("_numbered", F.col(order).isNotNull()).withColumn("_block", F.when(F.col("_numbered"), at(order, block)).otherwise(at(value, UNNUMBERED_BLOCK)))
    of = [*keys, "_numbered", "_block"]
    blocks = rows.groupBy(*of).agg(F.max(value).alias("_m"))
    earlier = blocks.withColumn("_before", F.max("_m").over(Window.partitionBy(*keys).orderBy("_numbered", "_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    inside = F.max(value).over(Window.partitionBy(*of).orderBy(order, value).rowsBetween(Window.unboundedPreceding, -1))
    return join(rows.withColumn("_in", inside), earlier, of).withColumn(name, F.greatest("_in", "_before")).drop("_numbered", "_block", "_in", "_before")


def with_previous(rows: DataFrame, keys: list[str], order: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with ``previous``: a struct of ``columns`` of the row before, by ``order`` (nulls first); null at the first."""
    rows = rows.withColumn("_block", F.floor(F.col(order) / F.lit(block).cast("decimal(20,0)")).cast("bigint"))
    packed = F.struct(F.col(order).alias("_at"), *columns)
    last = rows.groupBy(*keys, "_block").agg(F.max(packed).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_block") if keys else Window.orderBy("_block")  # one row per block
    earlier = last.withColumn("_earlier", F.lag("_last").over(over)).drop("_last")
    inside = F.lag(packed).over(Window.partitionBy(*keys, "_block").orderBy(order, *columns))
    return join(rows.withColumn("_in", inside), earlier, [*keys, "_block"]).withColumn("previous", F.coalesce("_in", "_earlier")).drop("_block", "_in", "_earlier")


def disorder(messages: DataFrame, lateness_ns: int) -> DataFrame:
    """Messages with ``late`` (before the run's largest time so far less the lateness) and ``out_of_order`` (before the topic's largest accepted time).

    Messages without an arrival number count as the first ones, in the order of their times, and so do those of one
    number among themselves; null runs and topics are runs and topics of their own.
    """
    rows = with_max_before(messages, ["run_id"], "log_time_ns", "arrival_seq", "run_max_ns")
    rows = rows.withColumn("late", F.coalesce(F.col("log_time_ns") < F.col("run_max_ns") - lateness_ns, F.lit(False)))
    rows = rows.withColumn("_accepted", F.when(~F.col("late"), F.col("log_time_ns")))
    rows = with_max_before(rows, ["run_id", "topic"], "_accepted", "arrival_seq", "topic_max_ns")
    return rows.withColumn("out_of_order", F.coalesce(F.col("log_time_ns") < F.col("topic_max_ns"), F.lit(False))).drop("_accepted")


def disorder_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("run_id", "topic").agg(F.count(F.lit(1)).alias("received"), F.count_if("late").alias("late_count"), F.count_if("out_of_order").alias("out_of_order_count"))


def accepted(marked: DataFrame) -> DataFrame:
    return marked.where(~F.col("late"))


def sequence_gaps(events: DataFrame, order: str, sequence: str = "sequence_index", keys: list[str] | None = None) -> DataFrame:
    """Positive jumps between consecutive sequence numbers, in file order."""
    rows = with_previous(events.where(F.col(sequence).isNotNull()), keys or [], order, [sequence])
    size = F.col(sequence) - F.col(f"previous.{sequence}") - 1
    return rows.where(size > 0).select(*(keys or []), F.col(f"previous.{sequence}").alias("prev_sequence"), F.col(sequence).alias("next_sequence"), size.alias("gap_size"))


def append_violations(batch: DataFrame, tail: DataFrame, order: str) -> DataFrame:
    """Rows of a batch that don't follow the row before in the file, the first one the stored ``tail``.

    ``order`` is an integer column that tells where a row stands in the file (an offset, say); ``tail`` has one row
    (last_indexed_seq, last_event_hash), or none if nothing is stored yet, and then the first row follows anything. A
    row without a sequence number is a violation, and the row after it can't show that it follows.
    """
    stored = tail.select("last_indexed_seq", "last_event_hash", F.lit(True).alias("_stored")).limit(1)
    rows = with_previous(batch, [], order, ["sequence_index", "event_hash"]).join(F.broadcast(stored), how="left")  # one row is sent
    first = F.col("previous").isNull()
    seq = F.when(first, F.col("last_indexed_seq")).otherwise(F.col("previous.sequence_index"))
    expected = F.when(first, F.col("last_event_hash")).otherwise(F.col("previous.event_hash"))
    free = first & F.col("_stored").isNull()
    code = F.when(F.col("sequence_index").isNull(), "sequence_missing").when(~free & ~F.col("sequence_index").eqNullSafe(seq + 1), "sequence_break").when(~free & ~F.col("prev_event_hash").eqNullSafe(expected), "hash_break")
    return rows.select("event_id", "sequence_index", seq.alias("expected_after"), code.alias("code")).where("code is not null")


def append_batch(batch: DataFrame, tail: DataFrame, order: str) -> DataFrame:
    """The whole batch, or none of it if any row breaks the chain."""
    broken = append_violations(batch, tail, order).limit(1).select(F.lit(1).alias("broken"))
    return batch.join(F.broadcast(broken), how="left_anti")  # one row at most


def tail_agrees(events: DataFrame, offset: str) -> DataFrame:
    """Whether the last row by sequence is the last by offset."""
    row = F.struct("sequence_index", offset)
    last = events.agg(F.max_by(row, "sequence_index").alias("a"), F.max_by(row, offset).alias("b"))
    return last.select(F.col("a.sequence_index").alias("last_by_sequence"), F.col("b.sequence_index").alias("last_by_offset"), F.col("a").eqNullSafe(F.col("b")).alias("agrees"))


def end_to_end(messages: DataFrame, gap_ns: int, segment: str = "run_id") -> DataFrame:
    """Segments (a null one first) shifted in time so that each starts ``gap_ns`` after the one before ends; there is one row per segment to sum over."""
    spans = messages.groupBy(segment).agg(F.min("log_time_ns").alias("_first"), (F.max("log_time_ns") - F.min("log_time_ns")).alias("_span"))
    before = F.coalesce(F.sum(F.col("_span") + gap_ns).over(Window.orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = spans.select(segment, (before - F.col("_first")).alias("shift_ns"))
    return join(messages, shifts, [segment]).withColumn("log_time_ns", F.col("log_time_ns") + F.col("shift_ns"))


def regressions(messages: DataFrame, keys: list[str]) -> DataFrame:
    """How often time goes back in arrival order."""
    rows = with_previous(messages, keys, "arrival_seq", ["log_time_ns"])
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("log_time_ns") < F.col("previous.log_time_ns")).alias("regressions"))
