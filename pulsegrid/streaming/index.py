"""The trace index, kept up to date by appended files: events, sequence gaps and category counts, and its tail.

Each micro-batch takes whole files, in the order of their names, and rows in the order of their offsets. It is appended
if its chain is unbroken from the tail on, and else rejected as a whole; without ``strict`` any chain is taken and its
jumps are listed as gaps. What it adds (its rows, its gaps with the one at the seam, its counts) is written under its
number, so after each micro-batch the index is that of a build from all files so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.keys import join_summary
from pulsegrid.operators.ordering import append_violations, sequence_gaps
from pulsegrid.operators.trace import category_counts
from pulsegrid.shared import stored
from pulsegrid.streaming.versions import Versions, each_version

TAIL = "last_indexed_seq bigint, last_event_hash string, last_event_id string, last_file string, last_offset bigint, events bigint"
GAPS = "prev_sequence bigint, next_sequence bigint, gap_size bigint"
COUNTS = "category string, name string, n bigint"
REJECTED = "event_id string, sequence_index bigint, expected_after bigint, code string"
#: Offsets of a file are below this.
FILE_BYTES = 1 << 44


def in_file_order(events: DataFrame, file: str, offset: str, name: str = "_order") -> DataFrame:
    """``events`` with an integer that orders them by file name, then by offset; there is a row a file to number."""
    files = events.select(file).distinct().withColumn("_file", F.row_number().over(Window.orderBy(file)).cast("bigint"))
    return join_summary(events, files, [file]).withColumn(name, F.col("_file") * FILE_BYTES + F.col(offset)).drop("_file")


class TraceIndex:
    """An index in tables below a folder; ``schema`` is that of the events, with their file and offset."""

    def __init__(self, versions: Versions, schema: str, file: str = "file", offset: str = "byte_offset", strict: bool = True, categories: tuple[str, ...] = ("event_type", "source_topic", "source_node", "clock_domain", "time_source")):
        self.v, self.schema, self.file, self.offset, self.strict, self.categories = versions, schema, file, offset, strict, categories

    def step(self, batch: DataFrame, number: int) -> None:
        tail = self.v.read("tail", TAIL, number - 1)
        rows = stored(in_file_order(batch, self.file, self.offset), "batch")
        broken = stored(append_violations(rows, tail, "_order"), "violations") if self.strict else tail.limit(0).select(F.lit("").alias("event_id"), F.lit(0).cast("bigint").alias("sequence_index"), F.lit(0).cast("bigint").alias("expected_after"), F.lit("").alias("code"))
        rejected = self.strict and bool(broken.head(1))
        taken = rows.limit(0) if rejected else rows
        seam = tail.select(F.col("last_indexed_seq").alias("sequence_index"), F.lit(-1).cast("bigint").alias("_order"))
        self.v.write(taken.drop("_order").sortWithinPartitions("sequence_index"), "events", number)
        self.v.write(sequence_gaps(seam.unionByName(taken.select("sequence_index", "_order")), "_order"), "gaps", number)
        self.v.write(category_counts(taken, self.categories), "counts", number)
        self.v.write(broken, "rejected", number)
        last = F.struct("_order", "event_hash", "event_id", F.col(self.file).cast("string").alias("file"), F.col(self.offset).cast("bigint").alias("offset"))
        new = taken.agg(F.max(F.when(F.col("sequence_index").isNotNull(), F.struct("_order", "sequence_index"))).alias("s"), F.max(last).alias("l"), F.count(F.lit(1)).alias("n"))
        # one row each: without new rows the tail stays as it was
        old = tail.select(F.struct(*tail.columns).alias("t"))
        both = new.join(F.broadcast(old), how="left")
        self.v.write(both.where("n > 0 or t is not null").select(F.coalesce("s.sequence_index", "t.last_indexed_seq").alias("last_indexed_seq"), F.coalesce("l.event_hash", "t.last_event_hash").alias("last_event_hash"), F.coalesce("l.event_id", "t.last_event_id").alias("last_event_id"), F.coalesce("l.file", "t.last_file").alias("last_file"), F.coalesce("l.offset", "t.last_offset").alias("last_offset"), (F.col("n") + F.coalesce("t.events", F.lit(0))).alias("events")), "tail", number)

    def run(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return each_version(events, self.v, checkpoint, self.step, **trigger)

    def events(self) -> DataFrame:
        return self.v.added("events", self.schema)

    def gaps(self) -> DataFrame:
        return self.v.added("gaps", GAPS)

    def counts(self) -> DataFrame:
        return self.v.added("counts", COUNTS).groupBy("category", "name").agg(F.sum("n").alias("n"))

    def rejected(self) -> DataFrame:
        return self.v.added("rejected", REJECTED)

    def tail(self) -> DataFrame:
        return self.v.read("tail", TAIL, self.v.last())
