"""Scans, sinks, recordings, streaming jobs."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.sources import mcap, tables
from pulsegrid.streaming import jobs

NS = 1_000_000_000


def text(s):
    return struct.pack("<I", len(s.encode())) + s.encode()


def record(op, body):
    return bytes([op]) + struct.pack("<Q", len(body)) + body


def recording(compression):
    """A small file in the public format: two chunks, two topics."""
    channels = record(4, struct.pack("<HH", 1, 1) + text("/a") + text("cdr") + struct.pack("<I", 0)) + record(4, struct.pack("<HH", 2, 0) + text("/b") + text("cdr") + struct.pack("<I", 0))
    schemas = record(3, struct.pack("<H", 1) + text("S") + text("ros2msg") + struct.pack("<I", 0))
    out, indexes = mcap.MAGIC + record(1, text("") + text("test")), b""
    for k in range(2):
        body = b"".join(record(5, struct.pack("<HIQQ", 1 + i % 2, i, k * 100 + i, k * 100 + i + 1) + b"x" * i) for i in range(4))
        plain = (schemas + channels if k == 0 else b"") + body
        if compression == "zstd":
            import zstandard

            packed = zstandard.ZstdCompressor().compress(plain)
        elif compression == "lz4":
            import pyarrow as pa

            packed = pa.compress(plain, codec="lz4", asbytes=True)
        else:
            packed = plain
        chunk = record(6, struct.pack("<QQQI", k * 100, k * 100 + 3, len(plain), 0) + text(compression) + struct.pack("<Q", len(packed)) + packed)
        indexes += record(8, struct.pack("<QQQQI", k * 100, k * 100 + 3, len(out), len(chunk), 0) + struct.pack("<Q", 0) + text(compression) + struct.pack("<QQ", len(packed), len(plain)))
        out += chunk
    out += record(15, struct.pack("<I", 0))
    start = len(out)
    out += schemas + channels + indexes + record(11, struct.pack("<QHIIIIQQ", 8, 1, 2, 0, 0, 2, 0, 103) + struct.pack("<I", 0))
    return out + record(2, struct.pack("<QQI", start, 0, 7)) + mcap.MAGIC


@pytest.mark.parametrize("compression", ["", "zstd", "lz4"])
def test_recordings(spark, tmp_path, compression):
    (tmp_path / "one.mcap").write_bytes(recording(compression))
    (tmp_path / "broken.mcap").write_bytes(b"nothing")
    t = mcap.tables(mcap.inspect(spark, str(tmp_path)))
    f = {r.path.rsplit("/", 1)[1]: r for r in t["files"].collect()}
    assert (f["one.mcap"].message_count, f["one.mcap"].end_ns, f["one.mcap"].has_summary, f["one.mcap"].summary_crc) == (8, 103, True, 7) and not f["broken.mcap"].has_summary
    assert sorted((r.topic, r.schema_name) for r in t["channels"].collect()) == [("/a", "S"), ("/b", None)]
    m = mcap.messages(t["chunks"], t["channels"])
    assert sorted((r.topic, r.log_time_ns, r.message_size) for r in m.collect()) == sorted(("/ab"[0] + "ab"[i % 2], k * 100 + i, i) for k in range(2) for i in range(4))
    assert mcap.messages(t["chunks"], t["channels"], 2, 101).count() == 3


def test_trace_lines(spark, tmp_path):
    lines = [json.dumps({"event_id": "a", "sequence_index": 1, "event_type": "X"}), "", "{broken", json.dumps({"event_id": "b", "seq": 2, "topic": "/t", "event_hash": "h"})]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    rows = tables.trace_jsonl(spark, str(tmp_path / "t.jsonl")).collect()
    assert len(rows) == 3 and sum(r._bad is not None for r in rows) == 1
    assert next(r for r in rows if r.event_id == "a").source_topic == "UNKNOWN"
    good, bad = tables.trace_jsonl_strict(spark, str(tmp_path / "t.jsonl"))
    assert [(r.event_id, r.sequence_index, r.source_topic) for r in good.collect()] == [("b", 2, "/t")]
    assert sorted(r.code for r in bad.collect()) == ["event_hash_missing", "unreadable"]


def test_metadata_files(spark, tmp_path):
    (tmp_path / "topics.json").write_text(json.dumps({"/a": {"sensor_category": "lidar", "expected_hz": 20.0}, "/b": {}}))
    got = {r.topic: (r.sensor_category, r.expected_hz) for r in tables.topic_metadata(spark, str(tmp_path / "topics.json")).collect()}
    assert got == {"/a": ("lidar", 20.0), "/b": ("unknown", None)}
    d = tmp_path / "sets" / "incident" / "imu_1"
    d.mkdir(parents=True)
    (d / "metadata.yaml").write_text("rosbag2_bagfile_information:\n  message_count: 3\n  duration: {nanoseconds: 2000000000}\n  topics_with_message_count:\n  - {topic_metadata: {name: /imu}, message_count: 3}\n")
    r = tables.dataset_metadata(spark, str(tmp_path / "sets")).first()
    assert (r.dataset_name, r.dataset_type, r.duration_sec, r.topics) == ("imu_1", "incident", 2.0, {"/imu": 3})


def test_bundle_corpus_and_sinks(spark, tmp_path):
    d = tmp_path / "run_1"
    d.mkdir()
    (d / "report_manifest.json").write_text(json.dumps({"report_bundle_id": "x", "schema_name": "s", "artifacts": [{"path": "p", "size_bytes": 3, "hash": {"algorithm": "sha256", "value": "h"}}]}))
    (d / "topic_profile.json").write_text(json.dumps({"/a": {"count": 5}, "/b": {"count": 6}}))
    (d / "evidence_windows.json").write_text(json.dumps({"/a": [{"window": 3, "score": 1.5}, {"window": 1, "score": 0.5}]}))
    t = tables.bundle_corpus(spark, str(tmp_path))
    assert sorted((r.run_id, r.topic, r["count"]) for r in t["profile"].collect()) == [("run_1", "/a", 5), ("run_1", "/b", 6)]
    assert [(r["rank"], r.window) for r in t["windows"].orderBy("rank").collect()] == [(1, 3), (2, 1)]
    assert t["artifacts"].first().sha256 == "h" and t["runs"].first().report_bundle_id == "x"
    tables.write_report(t["profile"], t["windows"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/profile")).count() == 2
    tables.write_json(t["profile"], str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_trace_index_is_sorted_by_file(spark, sf_dir, tmp_path):
    e = schema.trace_events_from_events(spark.read.parquet(f"{sf_dir}/events.parquet")).orderBy(F.rand(1))
    tables.write_trace_index(e, str(tmp_path / "ix"), 4)
    spans = spark.read.parquet(str(tmp_path / "ix")).groupBy(F.input_file_name().alias("f")).agg(F.min("sequence_index").alias("a"), F.max("sequence_index").alias("z")).orderBy("a").collect()
    assert len(spans) == 4 and all(x.z < y.a for x, y in zip(spans, spans[1:]))


def run_stream(df, out, mode="append"):
    df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/rows")


def source(spark, folder, rows):
    """One file per list of (topic, seconds), read one a micro-batch."""
    k = 0
    for i, part in enumerate(rows):
        data = [("r", t, round(s * NS), 0, k + j, 0, 0, 1, k + j) for j, (t, s) in enumerate(part)]
        k += len(part)
        spark.createDataFrame(data, schema.MESSAGES).coalesce(1).write.parquet(f"{folder}/p{i}")
    raw = spark.readStream.schema(schema.MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    return raw.withColumn("ts", F.timestamp_micros(F.expr("log_time_ns div 1000")))


def test_stream_windows_close_behind_the_watermark(spark, tmp_path):
    m = source(spark, str(tmp_path / "in"), [[("a", 0.0), ("a", 0.5), ("a", 1.2)], [("a", 9.0)], [("a", 20.0)]])
    got = {(r.topic, int(r.start.timestamp())): (r["count"], r.max_gap_ns) for r in run_stream(jobs.stream_windows(m, "1 second", "2 seconds", "250 milliseconds"), str(tmp_path / "out")).collect()}
    assert got[("a", 0)] == (2, 500_000_000) and got[("a", 1)] == (1, 0) and ("a", 20) not in got


def test_fold_of_one_topic_is_the_batch_rule(spark, tmp_path):
    m = source(spark, str(tmp_path / "in"), [[("a", 1000 + s) for s in (0, 0.5, 1.2, 1.3, 1.6, 3.6, 3.4, 3.9, 1.0, 4.0, 6.2, 9.5)]])
    rows = run_stream(jobs.arrival_fold(m, 1000 * NS, NS, 2 * NS), str(tmp_path / "out")).orderBy("window").collect()
    assert [(r.window, r["count"], r.max_gap_ns) for r in rows][:4] == [(0, 2, 500_000_000), (1, 3, 300_000_000), (3, 3, 500_000_000), (4, 1, 0)]
    assert rows[2].missing_before == 1 and rows[-1].late_count == 1 and rows[-1].out_of_order_count == 2


def test_fold_of_a_large_group_from_shuffled_files(spark, tmp_path):
    rows = spark.range(25_000).selectExpr("'r' run_id", "'a' topic", f"id * {NS // 100} + {1000 * NS} log_time_ns", "0 b", "id c", "0 d", "0 e", "1 f", "id g")
    rows = rows.toDF(*spark.createDataFrame([], schema.MESSAGES).columns)
    cast = rows.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], schema.MESSAGES).schema])
    cast.repartition(5, F.xxhash64("arrival_seq")).orderBy(F.xxhash64("arrival_seq")).write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(schema.MESSAGES).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_micros(F.expr("log_time_ns div 1000")))
    got = run_stream(jobs.arrival_fold(raw, 1000 * NS, NS, 2 * NS), str(tmp_path / "out")).orderBy("window").collect()
    assert [(r.window, r["count"], r.late_count, r.out_of_order_count) for r in got][:200] == [(k, 100, 0, 0) for k in range(200)]


def test_append_ingest_takes_whole_batches(spark, tmp_path):
    cols = "event_id string, sequence_index bigint, event_hash string, prev_event_hash string, byte_offset bigint"
    for i, rows in enumerate([[("e3", 3, "h3", "h2", 0), ("e4", 4, "h4", "h3", 9)], [("e9", 9, "h9", "h4", 18)], [("e5", 5, "h5", "h4", 18)]]):
        spark.createDataFrame(rows, cols).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
        q = None
        store = str(tmp_path / "store")
        tail = lambda: spark.createDataFrame([(2, "h2")], "last_indexed_seq bigint, last_event_hash string") if not (tmp_path / "tail").exists() else spark.read.parquet(str(tmp_path / "tail")).orderBy(F.desc("last_indexed_seq")).limit(1)

        def write(batch, new_tail, number):
            batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
            new_tail.write.mode("append").parquet(str(tmp_path / "tail"))

        rejected = []
        stream = spark.readStream.schema(cols).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = jobs.append_ingest(stream, tail, write, lambda bad, n: rejected.extend(bad.collect()), str(tmp_path / "cp"), "byte_offset")
        q.awaitTermination()
        assert len(rejected) == (1 if i == 1 else 0)
    assert sorted(r.event_id for r in spark.read.parquet(store).collect()) == ["e3", "e4", "e5"]


def test_late_counts_over_many_batches(spark, tmp_path):
    m = source(spark, str(tmp_path / "in"), [[("a", 10.0), ("a", 9.5), ("b", 1.0)], [("a", 5.0), ("a", 12.0)], [("b", 0.5), ("a", 11.0)]])
    got = run_stream(jobs.late_counts(m, 2 * NS), str(tmp_path / "out")).groupBy("topic").agg(F.max("received").alias("n"), F.max("late_count").alias("late"), F.max("out_of_order_count").alias("ooo")).collect()
    assert sorted((r.topic, r.n, r.late, r.ooo) for r in got) == [("a", 5, 1, 3), ("b", 2, 0, 1)]
