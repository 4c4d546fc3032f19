"""Streams that keep tables: whatever the micro-batches, they end with what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ordering, trace, windows
from pulsegrid.sources import tables
from pulsegrid.streaming.index import TraceIndex
from pulsegrid.streaming.report import Report
from pulsegrid.streaming.versions import Versions

MESSAGES = "run_id string, topic string, log_time_ns bigint, arrival_seq bigint"
W, LATE = 1000, 2500


def files_of(spark, rows, schema, folder, cuts):
    """Rows as files that a stream takes one a micro-batch, in order."""
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/f{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


@pytest.fixture(scope="module")
def arrivals():
    """Two runs (one null) and topics, disordered and late rows, some before the run's first time, long silences."""
    r, rows = random.Random(11), []
    t = {"r": 50_000, None: 80_000}
    for i in range(420):
        run = r.choice(["r", None])
        t[run] += r.choice([5, 50, 200, 200, 900, 7000 if i % 40 == 9 else 10])
        back = r.choice([0, 0, 0, 300, 1800, 4000])
        rows.append((run, r.choice(["a", "a", "b", None]), t[run] - (back if i > 3 else 0), i))
    rows[2] = (rows[0][0], "a", rows[0][2] - 700, 2)
    return rows


@pytest.mark.parametrize("cuts", [[], [1, 90, 91]], ids=["one", "odd"])
def test_report_of_a_stream_is_that_of_the_batch(spark, arrivals, tmp_path, cuts):
    report = Report(Versions(spark, str(tmp_path / "tables")), W, LATE, 3)
    stream = files_of(spark, arrivals, MESSAGES, str(tmp_path / "in"), cuts)
    report.run(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert report.v.last() == len(cuts)
    m = spark.createDataFrame(arrivals, MESSAGES)
    d = ordering.disorder(m, LATE)
    start = {run: next(x[2] for x in arrivals if x[0] == run) for run in ("r", None)}
    want, early = {}, {}
    for x in d.collect():
        key = (x.run_id, x.topic)
        n = want.setdefault(key, [0, 0, 0, 0])
        before = not x.late and x.log_time_ns < start[x.run_id]
        for k, v in enumerate((1, x.late, x.out_of_order, before)):
            n[k] += v
        early[x.arrival_seq] = x.late or before
    assert {(x.run_id, x.topic): [x.received, x.late_count, x.out_of_order_count, x.before_start_count] for x in report.counts().collect()} == want
    assert sum(n[1] for n in want.values()) > 5 and sum(n[3] for n in want.values()) > 0
    kept = spark.createDataFrame([x for x in arrivals if not early[x[3]]], MESSAGES)
    batch_profile, batch_ranked = windows.timing_report(kept, W, 3)
    for _ in range(1 + (not cuts)):  # the state stays as it is
        profile, ranked = report.finish()
        assert sorted(map(tuple, profile.select(batch_profile.columns).collect()), key=str) == sorted(map(tuple, batch_profile.collect()), key=str)
        assert sorted(map(tuple, ranked.select(batch_ranked.columns).collect()), key=str) == sorted(map(tuple, batch_ranked.collect()), key=str)
    closed = report.windows()
    own = {(x.run_id, x.topic, x.window): (x.count, x.gap_max) for x in windows.observed_windows(kept, W).collect()}
    found = {(x.run_id, x.topic, x.window): (x["count"], x.gap_max) for x in closed.collect()}
    assert len(found) > 20 and all(own[k][1] == v[1] for k, v in found.items()) and closed.count() == len(found)


def test_a_repeated_batch_changes_nothing(spark, arrivals, tmp_path):
    report = Report(Versions(spark, str(tmp_path / "tables")), W, LATE, 3)
    report.v.start()
    for number, part in enumerate((arrivals[:200], arrivals[200:])):
        for _ in range(2):  # lost before its commit
            report.step(spark.createDataFrame(part, MESSAGES), number)
        report.v.commit(number)
    once = Report(Versions(spark, str(tmp_path / "once")), W, LATE, 3)
    once.v.start()
    once.step(spark.createDataFrame(arrivals, MESSAGES), 0)
    once.v.commit(0)
    for a, b in zip(report.finish(), once.finish()):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert sorted(report.counts().collect(), key=str) == sorted(once.counts().collect(), key=str)


EVENTS = "event_id string, sequence_index bigint, event_hash string, prev_event_hash string, event_type string, source_topic string, source_node string, clock_domain string, time_source string, ros_time double, file string, byte_offset bigint"


def events_of(numbers, per_file=7):
    out, before = [], "0"
    for k, i in enumerate(numbers):
        out.append((f"e{i}", i, f"h{i}", before, "ab"[i % 2], f"t{i % 3}", None if i % 5 == 0 else "n", "c", "s", i / 2, f"f{k // per_file:03d}", k % per_file * 10))
        before = f"h{i}"
    return out


def same(df, other):
    return sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, other.select(df.columns).collect()), key=str)


def rebuilt(spark, rows, folder):
    from pulsegrid.streaming.index import in_file_order

    e = in_file_order(spark.createDataFrame(rows, EVENTS), "file", "byte_offset", "at")
    totals = tables.write_index(e, folder, 3, "at")
    return totals, *(spark.read.parquet(f"{folder}/{x}") for x in ("events", "gaps", "counts"))


def test_index_after_each_batch_is_a_rebuild(spark, tmp_path):
    """Several files a micro-batch, shuffled rows, jumps of the sequence at seams too."""
    rows = events_of([i for i in range(80) if i % 9 != 4 and i not in (28, 29, 30)])
    index = TraceIndex(Versions(spark, str(tmp_path / "index")), EVENTS, strict=False)
    index.v.start()
    for number, (a, b) in enumerate(((0, 7), (7, 28), (28, len(rows)))):
        index.step(spark.createDataFrame(rows[a:b], EVENTS).orderBy(F.rand(1)), number)
        index.v.commit(number)
        totals, events, gaps, counts = rebuilt(spark, rows[:b], str(tmp_path / f"whole{number}"))
        assert same(index.events(), events) and same(index.gaps(), gaps) and same(index.counts(), counts)
        t = index.tail().first()
        assert (t.last_indexed_seq, t.last_event_id, t.last_file, t.last_offset, t.events) == (rows[b - 1][1], rows[b - 1][0], *rows[b - 1][-2:], b)
        assert (totals["events"], totals["bad"], totals["max_ros_time"]) == (b, 0, rows[b - 1][9])
    assert index.gaps().count() == 9


def test_strict_index_rejects_whole_batches(spark, tmp_path):
    rows = events_of(range(42))
    bad = [(*x[:3], "wrong", *x[4:]) if x[1] == 24 else x for x in rows]
    stream = files_of(spark, bad[:14], EVENTS, str(tmp_path / "in"), [7])
    index = TraceIndex(Versions(spark, str(tmp_path / "index")), EVENTS)
    run = lambda: index.run(stream, str(tmp_path / "checkpoint")).awaitTermination()
    run()
    assert index.events().count() == 14 and index.tail().first().events == 14 and index.rejected().count() == 0
    spark.createDataFrame(bad[14:28], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / "f100"))
    run()
    assert index.events().count() == 14 and [(x.event_id, x.code) for x in index.rejected().collect()] == [("e24", "hash_break")]
    spark.createDataFrame(rows[14:], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / "f200"))
    run()
    assert index.events().count() == 42 and index.gaps().count() == 0 and index.tail().first().last_event_hash == "h41"
    assert same(index.counts(), trace.category_counts(spark.createDataFrame(rows, EVENTS)))


def test_slices_of_a_stream_are_written_by_many_tasks(spark, tmp_path):
    """A slice has a file of each task that holds rows of it, and each row comes once, in the slices' order."""
    from types import SimpleNamespace

    from pulsegrid.plans import files

    seen = []
    take = lambda stream: SimpleNamespace(awaitTermination=lambda: seen.append(sorted(r.id for r in spark.read.parquet(*map(str, tmp_path.glob("f*"))).collect())))
    files.arrivals(spark.range(0, 100, 1, 10), "id", 4, str(tmp_path), take, 2)
    assert seen == [list(range(50)), list(range(100))]
    assert all(len(list(f.glob("part-*.parquet"))) > 1 for f in tmp_path.glob("f*"))
