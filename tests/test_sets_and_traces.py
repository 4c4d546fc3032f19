"""Comparison, gate, reference sets, traces, audits."""

import json

from pyspark.sql import functions as F

from pulsegrid.functions import scalar as X
from pulsegrid.operators import audit, compare, datasets, gate, ordering, reference_set, slices, trace


def run_row(name, **change):
    row = {
        "run_id": name, "schema_name": "s", "schema_version": "1", "bundle_schema": {"name": "b", "version": "1"}, "engine": {"name": "e", "version": "1"}, "source": {"format": "mcap"},
        "extraction": {"semantics": "o", "mode": "w", "timestamp_unit": "ns", "window_sec": 1.0, "allowed_lateness_sec": 2.0, "top": 5},
    }
    for path, value in change.items():
        *outer, last = path.split("__")
        at = row
        for o in outer:
            at = at[o]
        at[last] = value
    return row


RUNS = "run_id string, schema_name string, schema_version string, bundle_schema struct<name:string,version:string>, engine struct<name:string,version:string>, source struct<format:string>, extraction struct<semantics:string,mode:string,timestamp_unit:string,window_sec:double,allowed_lateness_sec:double,top:double>"


def test_gate_matrix(spark):
    cases = {
        "same": {}, "window_float": {"extraction__window_sec": 1.0}, "version": {"engine__version": "2"}, "format": {"source__format": "bag"},
        "name": {"schema_name": "x"}, "missing": {"schema_version": None}, "blank": {"engine__name": " "}, "zero": {"extraction__window_sec": 0.0}, "negative": {"extraction__allowed_lateness_sec": -1.0}, "half": {"extraction__top": 2.5}, "unit": {"extraction__timestamp_unit": "us"},
    }
    runs = spark.read.schema(RUNS).json(spark.sparkContext.parallelize([json.dumps(run_row("ref")), *[json.dumps(run_row(k, **v)) for k, v in cases.items()]]))
    pairs = spark.createDataFrame([("ref", k) for k in cases], "reference_id string, target_id string")
    got = {r.target_id: (r.compatible, r.blocking, r.warnings) for r in gate.compatibility(gate.checks(pairs, runs)).collect()}
    for k in cases:
        good = k in ("same", "window_float", "version", "format")
        assert got[k] == (good, 0 if good else 1, 1 if k in ("version", "format") else 0), k


def test_topic_sides(spark):
    t = lambda *x: spark.createDataFrame([(i,) for i in x], "topic string")
    got = {r.topic: r.side for r in compare.topic_sides(t("/z", "/a"), t("/z", "/b"), ["topic"]).collect()}
    assert got == {"/z": "common", "/a": "reference_only", "/b": "target_only"}


def test_evidence_summaries_ignore_order_and_mark_one_sided(spark):
    schema = "run_id string, topic string, score double, count_ratio double, max_gap_ns bigint, jitter_ns bigint"
    rows = [("a", "t", 1.0, 0.8, 10, 2), ("a", "t", 3.0, 0.6, 30, 4), ("b", "t", 3.0, 0.6, 30, 4), ("b", "t", 1.0, 0.8, 10, 2)]
    profile = spark.createDataFrame([("a", "t", 1), ("b", "t", 1), ("c", "t", 1)], "run_id string, topic string, count bigint")
    summary = compare.evidence_summary(profile, spark.createDataFrame(rows, schema))
    pairs = spark.createDataFrame([("a", "b"), ("c", "a")], "reference_id string, target_id string")
    f = compare.compare_fields(pairs, profile, summary)
    assert f.where("reference_id = 'a' and changed").count() == 0
    mine = f.where("reference_id = 'c' and field like 'evidence.%'")
    assert mine.where("changed and non_comparable").count() == 5
    n = mine.where("field = 'evidence.selected_window_count'").first()
    assert (n.reference, n.target, n.changed, n.non_comparable) == (0.0, 2.0, True, False)


def test_reference_set_counts(spark):
    sides = spark.createDataFrame([("A", "T", "/imu", "common"), ("A", "T", "/gps", "reference_only"), ("A", "T", "/camera", "target_only"), ("B", "T", "/camera", "common"), ("B", "T", "/imu", "common")], "reference_id string, target_id string, topic string, side string")
    fields = spark.createDataFrame([("A", "T", "/imu", "profile.count", True), ("B", "T", "/imu", "profile.count", False), ("B", "T", "/camera", "profile.max_gap_ns", True)], "reference_id string, target_id string, topic string, field string, changed boolean")
    got = {(r.topic, r.field): (r.eligible, r.changed, r.unchanged, r.scope) for r in reference_set.field_counts(fields).collect()}
    assert got == {("/imu", "profile.count"): (2, 1, 1, "some"), ("/camera", "profile.max_gap_ns"): (1, 1, 0, "all")}
    pairs = sides.select("reference_id", "target_id").distinct()
    t = {r.topic: (r.common, r.target_only, r.reference_only, r.absent) for r in reference_set.topic_counts(pairs, sides).collect()}
    assert t == {"/imu": (2, 0, 0, 0), "/gps": (0, 0, 1, 1), "/camera": (1, 1, 0, 0)}


def test_lineage(spark):
    rows = [("ok", "a", None), ("ok", "b", "a"), ("ok", "c", "a"), ("lost", "a", None), ("lost", "b", "x"), ("two", "a", None), ("two", "b", None), ("ring", "a", None), ("ring", "b", "c"), ("ring", "c", "b")]
    got = {r.baseline_id: r.valid for r in reference_set.lineage(spark.createDataFrame(rows, "baseline_id string, revision_id string, parent_revision_id string")).collect()}
    assert got == {"ok": True, "lost": False, "two": False, "ring": False}


def test_reviews(spark):
    rows = [("1", "s", None), ("2", "s", "1"), ("3", "s", "2"), ("4", "f", None), ("5", "f", "4"), ("6", "f", "4"), ("7", "l", "7"), ("8", "r", None), ("9", "r", None)]
    got = {r.subject: (r.effective_review_id, r.violations) for r in reference_set.review_chains(spark.createDataFrame(rows, "review_id string, subject string, supersedes_review_id string")).collect()}
    assert got["s"] == ("3", []) and got["f"] == (None, ["terminals", "fork"]) and "self_link" in got["l"][1] and got["r"][1] == ["roots", "terminals"]
    rows = [("1", "u", None), ("2", "u", "x"), ("a", "c", None), ("b", "c", "d"), ("d", "c", "b"), ("e", "m", None), ("f", "n", "e"), ("g", None, None)]
    got = {r.subject: (r.effective_review_id, r.violations) for r in reference_set.review_chains(spark.createDataFrame(rows, "review_id string, subject string, supersedes_review_id string")).collect()}
    assert got["u"] == (None, ["terminals", "supersedes_unknown"]) and got["c"] == (None, ["cycle"]) and "subject_changed" in got["n"][1] and got[None] == ("g", [])


def test_lineage_of_a_long_chain_keeps_its_plan_flat(spark):
    chain = spark.range(5000).selectExpr("'b' baseline_id", "id revision_id", "if(id > 0, id - 1, null) parent_revision_id")
    out = reference_set.lineage(chain)
    assert len(out._jdf.queryExecution().analyzed().toString()) < 20_000
    r = out.first()
    assert (r.roots, r.revisions, r.unreachable, r.valid) == (1, 5000, 0, True)


def test_repeated_rows_change_and_cost_nothing(spark, monkeypatch):
    """A chain of a thousand, every row twice: the codes of the chain, in log rounds, each of a row a node at most."""
    from pulsegrid.operators import reference_set as R

    chain = spark.range(1000).selectExpr("'b' baseline_id", "id revision_id", "if(id > 0, id - 1, null) parent_revision_id")
    kept, sizes = R.stored, []

    def counted(df, name):
        out = kept(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(R, "stored", counted)
    assert R.lineage(chain.union(chain)).collect() == R.lineage(chain).collect()
    assert max(n for _, n in sizes) <= 1000 and len(sizes) < 40
    reviews = chain.selectExpr("revision_id review_id", "'s' subject", "parent_revision_id supersedes_review_id")
    (row,) = R.review_chains(reviews.union(reviews)).collect()
    assert (row.effective_review_id, row.violations) == (999, [])


def test_unrooted_equals_search_by_hand(spark):
    """Random graphs in which a node has several rows, of several parents, null and unknown ones too."""
    import random

    r = random.Random(4)
    for n in (4, 8, 30):
        rows = [(k, r.randrange(n), r.choice([None, *range(n), n + 5] if r.random() < 0.15 else list(range(n)))) for k in ("a", None) for _ in range(2 * n)]
        rooted = {(k, i) for k, i, p in rows if p is None or (k, p) not in {(a, b) for a, b, _ in rows}}
        while more := {(k, i) for k, i, p in rows if (k, p) in rooted} - rooted:
            rooted |= more
        got = [(x.k, x.i) for x in reference_set.unrooted(spark.createDataFrame(rows, "k string, i int, p int"), ["k"], "i", "p").collect()]
        assert sorted(got, key=str) == sorted({(k, i) for k, i, _ in rows} - rooted, key=str)


def test_append_batches(spark):
    schema = "event_id string, sequence_index bigint, event_hash string, prev_event_hash string, at bigint"
    tail = spark.createDataFrame([(2, "h2")], "last_indexed_seq bigint, last_event_hash string")
    ok = spark.createDataFrame([("e3", 3, "h3", "h2", 0), ("e4", 4, "h4", "h3", 1)], schema)
    assert ordering.append_violations(ok, tail, "at").count() == 0 and ordering.append_batch(ok, tail, "at").count() == 2
    for row, code in ((("e99", 99, "h", "h2", 0), "sequence_break"), (("e3", 3, "h3", "f" * 64, 0), "hash_break"), (("e3", None, "h3", "h2", 0), "sequence_missing")):
        bad = spark.createDataFrame([row], schema)
        assert [r.code for r in ordering.append_violations(bad, tail, "at").collect()] == [code] and ordering.append_batch(bad, tail, "at").count() == 0
    assert ordering.append_batch(ok.limit(0), tail, "at").count() == 0
    # file order counts, not the sequence's own; a missing number breaks the chain for the row behind it too
    swapped = spark.createDataFrame([("e3", 3, "h3", "h2", 0), ("e5", 5, "h5", "h4", 1), ("e4", 4, "h4", "h3", 2)], schema)
    assert [r.event_id for r in ordering.append_violations(swapped, tail, "at").orderBy("event_id").collect()] == ["e4", "e5"]
    gone = spark.createDataFrame([("e3", 3, "h3", "h2", 0), ("e4", None, "h4", "bad", 1), ("e5", 5, "h5", "h4", 2)], schema)
    assert [(r.event_id, r.code) for r in ordering.append_violations(gone, tail, "at").orderBy("event_id").collect()] == [("e4", "sequence_missing"), ("e5", "sequence_break")]
    assert ordering.append_violations(ok, tail.limit(0), "at").count() == 0  # nothing stored yet


def test_disorder_keeps_rows_with_nulls(spark):
    from pulsegrid.operators import windows

    rows = [("r", "a", 10, 0), ("r", "a", 30, None), ("r", "a", 5, 1), (None, "a", 7, 0), ("r", None, 8, 2)]
    m = spark.createDataFrame(rows, "run_id string, topic string, log_time_ns bigint, arrival_seq bigint")
    marked = ordering.disorder(m, 10)
    assert marked.count() == 5 and sum(r.received for r in ordering.disorder_counts(marked).collect()) == 5
    assert windows.aligned(m, 10).count() == 5 and windows.run_profile(windows.observed_windows(m, 10)).count() == 3


def test_focused_chain(spark):
    kinds = ["MOTION_SUMMARY", "PERCEPTION_SUMMARY", "COMMAND_SUMMARY"]
    events = spark.createDataFrame([(f"e{i}", i, kinds[i % 3], "/t") for i in range(200)], "event_id string, sequence_index bigint, event_type string, source_topic string")
    seeds = spark.createDataFrame([("s", 101)], "seed_id string, sequence_index bigint")
    got = sorted(r.sequence_index for r in trace.chains(seeds, events).collect())
    assert got == [96, 99, 100, 101, 102, 103, 105, 108, 111]
    s = trace.chain_summary(spark.createDataFrame([("e101",), ("none",)], "seed_id string"), events, 20)
    assert {r.seed_id: (r.status, r.rows_in_radius) for r in s.collect()} == {"e101": ("ok", 41), "none": ("seed_missing", 0)}


def test_search_and_counts(spark):
    e = spark.createDataFrame([("a", "x", "/t", 1.0, 1, '{"k": 1}'), ("b", "y", "/t", None, 2, '{"k": 2}'), ("c", "x", "/u", 0.5, 3, '{"k": 1}')], "event_id string, event_type string, source_topic string, ros_time double, sequence_index bigint, raw string")
    assert [r.event_id for r in slices.search_order(slices.search(e, event_type="x", contains='"k": 1')).collect()] == ["c", "a"]
    assert [r.event_id for r in slices.search_order(slices.search(e, topic="/t")).collect()] == ["a", "b"]
    assert slices.search_order(slices.ranked_search(e, "x", "/t"), "match_count", 1).first().event_id == "a"
    assert {(r.category, r.name): r.n for r in trace.category_counts(e, ("event_type", "source_topic")).collect()} == {("event_type", "x"): 2, ("event_type", "y"): 1, ("source_topic", "/t"): 2, ("source_topic", "/u"): 1}


def test_infinite_and_missing_rates(spark):
    d = spark.createDataFrame([("lidar_1", "incident", {"/scan": 10, "/new": 20}, 10.0, None), ("n1", "normal", {"/scan": 100, "/gone": 5}, 10.0, None)], "dataset_name string, dataset_type string, topics map<string,bigint>, duration_sec double, declared_topic string")
    c = {r.topic: (r.score, r.reason) for r in datasets.candidates(datasets.topic_rates(d)).collect()}
    assert c["/new"] == (float("inf"), "normal_missing_incident_present") and c["/scan"][1] == "rate_ratio" and "/gone" not in c
    assert datasets.verify(d).first().result == "REVIEW"


def test_artifacts_and_digests(spark, tmp_path):
    (tmp_path / "a.json").write_text("abc")
    (tmp_path / "b.json").write_text("abcd")
    actual = audit.actual_files(spark, str(tmp_path)).select(F.lit("r").alias("run_id"), F.element_at(F.split("path", "/"), -1).alias("path"), "size_bytes", "sha256")
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    declared = spark.createDataFrame([("r", "a.json", 3, h("abc")), ("r", "b.json", 4, h("zzzz")), ("r", "c.json", 1, "x")], "run_id string, path string, size_bytes bigint, sha256 string")
    assert {r.path: r.status for r in audit.artifact_integrity(declared, actual).collect()} == {"a.json": "ok", "b.json": "hash_differs", "c.json": "missing"}
    rows = spark.createDataFrame([("r", "x", 1), ("r", "y", 2), ("q", "y", 2), ("q", "x", 1)], "k string, a string, b int")
    assert rows.transform(lambda d: audit.group_digest(d, ["k"], ["a", "b"])).select("digest").distinct().count() == 1


def test_canonical_json_is_that_of_the_json_module(spark):
    texts = ["plain", 'q"uote\\', "é", "日本", "🙂", "tab\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.j for r in df.select(X.json_text(F.col("t")).alias("j")).collect()] == [json.dumps(t) for t in texts]


def test_dimension_maps(spark):
    rows = [({"b": " 2 ", " a": "1"},), ({"a": "1", "a ": "2"},), ({"": "1"},), ({"a": None},)]
    got = [r.m for r in spark.createDataFrame(rows, "d map<string,string>").select(X.canonical_map("d").alias("m")).collect()]
    assert list(got[0].items()) == [("a", "1"), ("b", "2")] and got[1:] == [None, None, None]


def test_many_nodes_are_hooked_with_few_rows_a_node(spark, monkeypatch):
    """A chain of 2,000 beside loops, a ring and what comes before these: all rounds together hold a few rows a node."""
    from pulsegrid.operators import reference_set as R

    kept, sizes = R.stored, []

    def counted(df, name):
        out = kept(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(R, "stored", counted)
    monkeypatch.setattr(R, "FEW", 200, raising=False)
    chain = [(n, n - 1 if n else None) for n in range(2000)]
    endless = [(3000, 3000), (3001, 3000), (3002, 3001), *[(4000 + n, 4000 + (n + 1) % 50) for n in range(50)], *[(5000 + n, 4999 + n if n else 4000) for n in range(50)]]
    lost = [(6000, -1), (6001, 6000)]
    rows = spark.createDataFrame(chain + endless + lost, "n bigint, p int")
    assert sorted(r.n for r in R.unrooted(rows, [], "n", "p").collect()) == sorted(n for n, _ in endless)
    assert sum(n for name, n in sizes if name == "paths") < 7 * rows.count()
