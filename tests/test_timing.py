"""Windows, gaps, disorder and ranking on small streams with known answers, and against a plain fold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import scalar as X
from pulsegrid.operators import gaps, ordering, slices, windows

NS = 1_000_000_000
B = 1_700_000_000_000_000_000


def stream(spark, rows, run="r"):
    """(topic, ns) in arrival order."""
    data = [(run, t, int(ns), int(ns), i, 0, 0, 1, i) for i, (t, ns) in enumerate(rows)]
    return spark.createDataFrame(data, schema.MESSAGES)


def sample(spark):
    rows = [("/lidar_top", B + i * 50_000_000) for i in range(100) if i != 45] + [("/imu", B + i * 10_000_000) for i in range(500)]
    return stream(spark, sorted(rows, key=lambda x: (x[1], x[0])))


def test_sample_stream(spark):
    profile, ranked = windows.timing_report(sample(spark), NS, 5)
    lidar = profile.where("topic = '/lidar_top'").first()
    assert (lidar["count"], lidar["avg_gap_ns"], lidar["max_gap_ns"], lidar["jitter_ns"]) == (99, 50510204, 100_000_000, 5024927)
    top = ranked.where("topic = '/lidar_top' and rank = 1").first()
    assert (top["window"], top["count"], top["expected_count"], top["jitter_ns"]) == (2, 19, 20, 11453071)
    assert top["count_ratio"] == 0.95 and math.isclose(top["score"], 1.557265, abs_tol=1e-6)
    assert {round(r.score, 6) for r in ranked.where("topic = '/lidar_top' and rank > 1").collect()} == {0.5}
    assert windows.run_summary(profile).first().total_messages == 599


def test_baseline_ranking_of_sample(spark):
    m = sample(spark).where("topic = '/lidar_top'")
    bounds = m.groupBy("topic").agg(F.min("log_time_ns").alias("start_ns"), F.lit(B + 4_990_000_000).alias("end_ns"))
    dense = windows.dense_windows(m, bounds, NS, ["topic"])
    assert dense.count() == 5
    ranked = windows.baseline_ranking(dense, 1.0, 10, ["topic"]).orderBy("rank").collect()
    assert len(ranked) == 4 and ranked[0].window == 2 and math.isclose(ranked[0].score, 10.744440, abs_tol=1e-5)


def test_dropout_is_one_missing_interval(spark):
    m = stream(spark, [("/lidar_top", i * 50_000_000) for i in range(400) if not 200 <= i < 220])
    w = windows.observed_windows(m, NS)
    assert w.count() == 19
    (gap,) = windows.missing_intervals(w).collect()
    assert (gap.gap_ns, gap.first_missing, gap.missing_window_count, gap.previous_observed_ns, gap.next_observed_ns) == (1_050_000_000, 10, 1, 9_950_000_000, 11_000_000_000)
    profile, ranked = windows.timing_report(m, NS, 3)
    p = profile.first()
    assert (p["count"], p["avg_gap_ns"], p["jitter_ns"]) == (380, 52638522, 51298739)
    top = ranked.where("rank = 1").first()
    assert (top.evidence_kind, top.window, top.count_ratio, top.missing_window_count) == ("sparse_missing_interval", 10, 0.0, 1) and math.isclose(top.score, 20.5)


def test_disorder_and_lateness(spark):
    rows = "a 0, b 0.1, a 0.5, a 1.2, b 3.5, a 1.3, a 1.6, a 3.6, a 3.4, b 6.0, a 3.9, a 4.0, a 6.2".split(", ")
    m = stream(spark, [(r.split()[0], round(float(r.split()[1]) * NS)) for r in rows])
    marked = ordering.disorder(m, 2 * NS)
    # the rule counts a late row as out of order too: it is before the topic's largest accepted time
    counts = {r.topic: (r.received, r.late_count) for r in ordering.disorder_counts(marked).collect()}
    assert counts == {"a": (10, 2), "b": (3, 0)}
    good = ordering.accepted(marked)
    w = {(r.topic, r.window): (r["count"], r.gap_max) for r in windows.observed_windows(good, NS).collect()}
    assert w == {("a", 0): (2, 500_000_000), ("a", 1): (2, 400_000_000), ("a", 3): (2, 0), ("a", 4): (1, 0), ("a", 6): (1, 0), ("b", 0): (1, 0), ("b", 3): (1, 0), ("b", 6): (1, 0)}
    assert [r.sequence for r in marked.where("late").orderBy("sequence").collect()] == [5, 10]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_values_do_not_depend_on_blocks(spark, block):
    r = random.Random(1)
    rows = [("k", i, r.randint(0, 50)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint")
    got = {x.at: (x.m, x.previous.v if x.previous else None) for x in ordering.with_previous(ordering.with_max_before(df, ["k"], "v", "at", "m", block), ["k"], "at", ["v"], block).collect()}
    for i in range(60):
        assert got[i] == (max((v for _, j, v in rows if j < i), default=None), rows[i - 1][2] if i else None)


def test_gap_statistics_equal_a_plain_fold(spark):
    r = random.Random(2)
    times = {t: sorted(r.randint(0, 40 * NS) for _ in range(n)) for t, n in (("a", 200), ("b", 1), ("c", 2), ("d", 57))}
    rows = [(t, ns) for t in times for ns in times[t]]
    r.shuffle(rows)
    got = {x.topic: x for x in gaps.gap_stats(stream(spark, rows), ["topic"], bucket_ns=NS).collect()}
    for t, ts in times.items():
        d = [b - a for a, b in zip(ts, ts[1:])]
        mean = sum(d) / len(d) if d else 0
        jitter = math.sqrt(sum((x - mean) ** 2 for x in d) / len(d)) if d else 0
        assert got[t]["count"] == len(ts)
        for name, value in (("avg_gap_sec", mean / NS), ("max_gap_sec", max(d, default=0) / NS), ("jitter_sec", jitter / NS)):
            assert math.isclose(got[t][name], value, rel_tol=1e-9, abs_tol=1e-12), (t, name)


def test_integer_square_root(spark):
    values = [0, 1, 2, 3, 4, 99, 100, 10**18 - 1, 10**18, 10**30 - 1, 10**30, (3 * 10**15 + 7) ** 2 - 1, (3 * 10**15 + 7) ** 2]
    df = spark.createDataFrame([(str(v),) for v in values], "v string")
    got = df.select(X.isqrt(F.col("v").cast("decimal(38,0)")).alias("r")).collect()
    assert [x.r for x in got] == [math.isqrt(v) for v in values]


def test_numeric_changes(spark):
    rows = [(100.0, 120.0), (0.0, 0.0), (0.0, 5.0), (None, 1.0)]
    got = [tuple(r.c) for r in spark.createDataFrame(rows, "a double, b double").select(X.numeric_change("a", "b").alias("c")).collect()]
    assert got == [(20.0, 1.2, "finite"), (0.0, 1.0, "both_zero"), (5.0, None, "reference_zero"), (None, None, None)]


def test_texts_and_times(spark):
    df = spark.createDataFrame([(1_700_000_000_123_456_789, "2024-01-01T00:00:00Z"), (5, "2024-01-01T00:00:00"), (None, "x")], "n bigint, t string")
    got = df.select(X.ns_text("n").alias("a"), X.iso_time("t").isNotNull().alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [("1700000000.123456789", True), ("0.000000005", False), ("N/A", False)]
    assert spark.range(1).select(X.seconds_to_ns(F.lit("1700000000.123456789")).alias("n")).first().n == 1_700_000_000_123_456_789


def test_slices_are_half_open_and_empty_tables_stay_empty(spark):
    m = stream(spark, [("a", 1), ("a", 2), ("b", 3)])
    assert slices.time_slice(m, 1, 3, ["a"]).count() == 2 and slices.time_slice(m, 2, 2).count() == 0
    empty = m.limit(0)
    assert [x.count() for x in windows.timing_report(empty, NS, 2)] == [0, 0]
    assert ordering.disorder(empty, NS).count() == 0 and gaps.gap_stats(empty, ["topic"]).count() == 0


def test_partition_count_does_not_matter(spark):
    m = sample(spark)
    want = sorted(map(tuple, windows.timing_report(m, NS, 5)[1].collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert sorted(map(tuple, windows.timing_report(m.orderBy(F.rand(3)), NS, 5)[1].collect()), key=repr) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_medians_equal_sorting(spark):
    import random

    r = random.Random(2)
    rows = [(k, r.choice([0.0, 0.5, r.random(), r.random() * 1e6]), float(r.randint(0, 3))) for k in ("a", "b", None) for _ in range(r.randint(1, 300))]
    got = {x.k: (x.u, x.v) for x in windows.upper_medians(spark.createDataFrame(rows, "k string, u double, v double"), ["k"], ["u", "v"]).collect()}
    for k in ("a", "b", None):
        mine = [x for x in rows if x[0] == k]
        assert got[k] == tuple(sorted(x[i] for x in mine)[len(mine) // 2] for i in (1, 2))


def test_selection_holds_no_group(spark, monkeypatch):
    """Many distinct values of all sizes, most of them close together: the right ones, from small cells only."""
    import random

    monkeypatch.setattr(windows, "CELLS", 16)
    r = random.Random(6)
    values = [r.choice([1, -1]) * r.random() * 10 ** r.choice([-300, -12, -12, -12, 0, 9, 300]) for _ in range(3000)] + [0.0, -1.7e308, 1.7e308, None] + [5e-13] * 40
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double")
    mine = sorted(v for v in values if v is not None)
    for rank in (lambda n: F.lit(0), lambda n: F.floor(n / 3), lambda n: F.floor(n / 2), lambda n: n - 1):
        n = spark.range(1).select(rank(F.lit(len(mine))).alias("i")).first().i
        assert [(x.k, x.v) for x in windows.selected(df, ["k"], ["v"], rank).collect()] == [("a", mine[n])]
    counts = spark.createDataFrame([("r", "t", i, c) for i, c in enumerate([5, 9, 1, 4])] + [(None, "u", 3, 8), (None, "u", 1, 6)], "run_id string, topic string, window bigint, count bigint")
    assert {(x.topic, x.expected_count) for x in windows.expected_counts(counts, 1.0, mode="median").collect()} == {("t", 4), ("u", 7)}
    assert {(x.topic, x.expected_count) for x in windows.expected_counts(counts, 1.0).collect()} == {("t", 5), ("u", 6)}


def test_windows_of_one_topic_in_blocks(spark, monkeypatch):
    """Profiles and missing intervals don't depend on how many windows a group stitches."""
    import random

    from pulsegrid.operators import gaps

    r = random.Random(8)
    times = sorted(r.sample(range(0, 40_000), 900) + [10**6, 10**6 + 1])
    m = spark.createDataFrame([(run, "t", t, i) for run in ("a", None) for i, t in enumerate(times)], "run_id string, topic string, log_time_ns bigint, arrival_seq bigint")
    w = windows.observed_windows(m, 10)
    both = lambda: (sorted(map(tuple, windows.missing_intervals(w).collect()), key=str), sorted(map(tuple, windows.run_profile(w).collect()), key=str))
    want = both()
    monkeypatch.setattr(windows, "STITCHED", 7)
    monkeypatch.setattr(gaps.stitched, "__defaults__", (7,))
    assert both() == want and len(want[0]) > 500
    mine = [b - a for a, b in zip(times, times[1:])]
    assert {(x[0], x[2], x[7]) for x in want[1]} == {(k, len(times), max(mine)) for k in ("a", None)}


def test_null_runs_and_equal_arrivals(spark):
    rows = [(None, "a", 5, 1), (None, "a", 9, 2), ("x", "a", 3, 3), ("x", None, 4, 4)]
    m = spark.createDataFrame(rows, "run_id string, topic string, log_time_ns bigint, arrival_seq bigint")
    got = [(x.run_id, x.log_time_ns) for x in ordering.end_to_end(m, 10).collect()]
    assert sorted(got, key=str) == sorted([(None, 0), (None, 4), ("x", 14), ("x", 15)], key=str)
    # equal numbers count in the order of their times, and so do rows without one, which come first
    times = [(50, 1), (10, 1), (30, 1), (20, 2), (5 * 10**12, None), (3, None), (9 * 10**12, None)]
    df = spark.createDataFrame([("r", "t", t, a) for t, a in times], "run_id string, topic string, log_time_ns bigint, arrival_seq bigint")
    found = {x.log_time_ns: (x.late, x.out_of_order) for x in ordering.disorder(df.orderBy(F.rand(1)), 10**13).collect()}
    assert found == {t: (False, t < 100 and t != 3) for t, _ in times}


def test_ranking_of_null_topics(spark):
    m = spark.createDataFrame([(None, i * 50_000_000 + (i % 7) * 1000, i) for i in range(200)], "topic string, log_time_ns bigint, arrival_seq bigint")
    bounds = spark.createDataFrame([(None, 0, 10**10)], "topic string, start_ns bigint, end_ns bigint")
    dense = windows.dense_windows(m, bounds, 10**9, ["topic"])
    assert windows.baseline_ranking(dense, 1.0, 3, ["topic"]).count() == 3
    from pulsegrid.operators import slices

    q = spark.createDataFrame([("w", None, 0, 20)], "window_id string, topic string, start_ns bigint, expected_count int")
    assert slices.evidence_window(m, q, 10**9).first().observed_count == 20


def test_grid_of_many_windows(spark):
    bounds = spark.createDataFrame([("a", 5, 100_005), ("b", 0, 7), ("c", 3, 3)], "k string, start_ns bigint, end_ns bigint")
    got = windows.grid(bounds, 3, ["k"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("a"), F.max("stop_ns").alias("z")).collect()
    assert sorted((x.k, x.n, x.a, x.z) for x in got) == [("a", 33_334, 5, 100_005), ("b", 3, 0, 7)]


def test_overlaps_equal_brute_force(spark):
    import random

    from pulsegrid.operators import slices

    r = random.Random(3)
    q = [(i, a := r.randint(0, 10**6), a + r.choice([0, 1, 50, 10**3, 10**6])) for i in range(150)]
    c = [(i, a := r.randint(0, 10**6), a + r.choice([0, 3, 64, 10**4, 2 * 10**6])) for i in range(150)]
    got = slices.overlapping_chunks(spark.createDataFrame(q, "query_id int, start_ns bigint, end_ns bigint"), spark.createDataFrame(c, "chunk_id int, message_start_ns bigint, message_end_ns bigint")).collect()
    assert sorted((x.query_id, x.chunk_id) for x in got) == sorted((i, j) for i, a, b in q for j, x, y in c if x <= b and y >= a)


def test_peak_open_windows(spark):
    m = spark.createDataFrame([("r", t, s, i) for i, (t, s) in enumerate([("a", 0), ("b", 2), ("a", 11), ("b", 13), ("a", 16), ("a", 40)])], "run_id string, topic string, log_time_ns bigint, arrival_seq bigint")
    assert windows.peak_open(m, 10, 5).first().peak_open == 4
