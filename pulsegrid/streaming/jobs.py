"""Structured Streaming forms of the windowed report, the arrival-order fold, the append ingest and the search.

``messages`` is a stream with run_id, topic, log_time_ns and ts, the time in microseconds for the watermark. The
watermark moves between micro-batches, so these jobs drop no row that the batch operators keep, and may keep some that
they drop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.operators.ordering import append_violations
from pulsegrid.operators.slices import search


def _largest_gap(ordered: str, first: str = "", last: str = ""):
    """The largest step between neighbours of an ordered array, from ``last`` of one to ``first`` of the next."""
    x = F.col(ordered)
    part = lambda e, name: e[name] if name else e
    return F.coalesce(F.array_max(F.transform(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda e, i: part(e, first) - part(F.get(x, i), last))), F.lit(0))


def stream_windows(messages: DataFrame, window: str, lateness: str, part: str, start: str = "0 seconds") -> DataFrame:
    """Tumbling windows per run and topic: count, first, last, largest gap.

    A window is first split into parts of ``part`` (which must divide it). Only times of parts that the watermark
    hasn't passed are held in state, each part by a group of its own; of older ones a row each until their window ends.
    """
    small = messages.withWatermark("ts", lateness).groupBy("run_id", "topic", F.window("ts", part, part, start).alias("part")).agg(F.array_sort(F.collect_list("log_time_ns")).alias("t"))
    rows = small.select("run_id", "topic", "part", F.struct(F.get("t", F.lit(0)).alias("first"), F.element_at("t", -1).alias("last"), F.size("t").cast("bigint").alias("n"), _largest_gap("t").alias("gap")).alias("x"))
    out = rows.groupBy("run_id", "topic", F.window("part", window, window, start)).agg(F.sum("x.n").alias("count"), F.min("x.first").alias("first_ns"), F.max("x.last").alias("last_ns"), F.max("x.gap").alias("inside"), F.array_sort(F.collect_list("x")).alias("xs"))
    return out.select("run_id", "topic", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "count", "first_ns", "last_ns", F.greatest("inside", _largest_gap("xs", "first", "last")).alias("max_gap_ns"))


FOLD = "run_id string, topic string, window bigint, count bigint, max_gap_ns bigint, late_count bigint, out_of_order_count bigint, missing_before bigint"
FOLD_STATE = "max_ns bigint, prev_ns bigint, last_window bigint, late bigint, disorder bigint, windows array<bigint>, counts array<bigint>, gaps array<bigint>, ends array<bigint>"


def arrival_fold(messages: DataFrame, start_ns: int, window_ns: int, lateness_ns: int) -> DataFrame:
    """Per run and topic, a fold in arrival order: open windows are held until the topic's largest time passes their end by the lateness.

    Emits finished windows with in-window gap, the running late and out-of-order counts, and how many windows are
    missing before it. State is a few numbers per open window. A topic without rows for a while is flushed when the
    watermark passes.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, prev, last, late, disorder, w, n, g, e = state.get if state.exists else (None, None, None, 0, 0, [], [], [], [])
        opened = {a: [b, c, d] for a, b, c, d in zip(w, n, g, e)}
        done = []

        def close(until: int | None) -> None:
            nonlocal last
            for k in sorted(k for k in opened if until is None or start_ns + (k + 1) * window_ns <= until):
                count, gap, _ = opened.pop(k)
                done.append((*key, k, count, gap, late, disorder, 0 if last is None else max(0, k - last - 1)))
                last = k

        if state.hasTimedOut:
            close(None)
        else:
            # Arrow batches come in the order of the shuffle: two numbers a row of the whole micro-batch are held
            rows = pd.concat([b[["arrival_seq", "log_time_ns"]] for b in batches])
            for t in rows.sort_values("arrival_seq").log_time_ns:
                t = int(t)
                if top is not None and t < top:
                    disorder += 1
                if top is not None and t < top - lateness_ns:
                    late += 1
                    continue
                top = t if top is None else max(top, t)
                k = (t - start_ns) // window_ns
                mine = opened.setdefault(k, [0, 0, None])
                mine[0] += 1
                if mine[2] is not None and t >= mine[2]:
                    mine[1] = max(mine[1], t - mine[2])
                mine[2] = t
                prev = t
                close(top - lateness_ns)
        keys = sorted(opened)
        if state.hasTimedOut and not keys:
            state.remove()
        else:
            state.update((top, prev, last, late, disorder, keys, [opened[k][0] for k in keys], [opened[k][1] for k in keys], [opened[k][2] for k in keys]))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (top or 0) // 1_000_000 + lateness_ns // 1_000_000 + window_ns // 1_000_000))
        yield pd.DataFrame(done, columns=[c.split()[0] for c in FOLD.split(", ")])

    watermarked = messages.withWatermark("ts", f"{max(1, lateness_ns // 1_000_000)} milliseconds")
    return watermarked.groupBy("run_id", "topic").applyInPandasWithState(fold, FOLD, FOLD_STATE, "append", GroupStateTimeout.EventTimeTimeout)


LATE = "run_id string, topic string, received bigint, late_count bigint, out_of_order_count bigint"


def late_counts(messages: DataFrame, lateness_ns: int) -> DataFrame:
    """Per run and topic, after each micro-batch that has rows of it: how many came so far, late or out of order.

    A row is late if it lies more than ``lateness_ns`` before its topic's largest time so far, out of order if before
    that time at all. State is four numbers a topic; counts only grow, so the largest are the newest.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, received, late, disorder = state.get if state.exists else (None, 0, 0, 0)
        rows = pd.concat([b[["arrival_seq", "log_time_ns"]] for b in batches])  # two numbers a row of the micro-batch
        t = rows.sort_values("arrival_seq").log_time_ns.astype("int64")
        before = t.cummax().shift(fill_value=t.iloc[0] if top is None else int(top))
        if top is not None:
            before = before.clip(lower=int(top))
        received, late, disorder = received + len(t), late + int((t < before - lateness_ns).sum()), disorder + int((t < before).sum())
        state.update((int(t.max()) if top is None else max(int(top), int(t.max())), received, late, disorder))
        yield pd.DataFrame([(*key, received, late, disorder)], columns=[c.split()[0] for c in LATE.split(", ")])

    return messages.groupBy("run_id", "topic").applyInPandasWithState(count, LATE, "top bigint, received bigint, late bigint, disorder bigint", "append", GroupStateTimeout.NoTimeout)


def stream_metrics(query: StreamingQuery) -> list[dict]:
    """Late rows dropped and open groups of each micro-batch so far."""
    return [{"batch": p.batchId, "dropped_late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators), "open": sum(s.numRowsTotal for s in p.stateOperators)} for p in query.recentProgress]


def append_ingest(events: DataFrame, read_tail: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame, int], None], reject: Callable[[DataFrame, int], None], checkpoint: str, order: str) -> StreamingQuery:
    """Append each micro-batch if its chain is unbroken from the stored tail on, else hand its violations to ``reject``.

    ``order`` is the column that tells where a row stands in its file, as for ``ordering.append_violations``.
    ``write`` gets the batch, its new tail and the batch's number, by which it must be idempotent: a batch is repeated
    if the job is lost between its write and its commit.
    """

    def each(batch: DataFrame, number: int) -> None:
        broken = append_violations(batch, read_tail(), order)
        if broken.head(1):
            reject(broken, number)
        elif batch.head(1):
            write(batch, batch.agg(F.max_by("sequence_index", order).alias("last_indexed_seq"), F.max_by("event_hash", order).alias("last_event_hash")), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_search(events: DataFrame, folder: str, checkpoint: str, **predicates) -> StreamingQuery:
    """Hits of a search, appended to Parquet."""
    return search(events, **predicates).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
