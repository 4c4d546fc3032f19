"""Registered queries over files: what the library's sources read and its sinks write.

Each query first lays the driver's tables down as files in the shared folder, in the form that a source reads, then
reads them back by it; its SQL says the same of the tables themselves.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid import schema
from pulsegrid.operators import audit, gate, windows
from pulsegrid.plans.queries import DAY0, DIS, HOUR, M, SQL, W, events, gap_sql, messages, query, rounded, trace_events, window_sql
from pulsegrid.shared import scratch, write_files
from pulsegrid.sources import mcap, tables
from pulsegrid.streaming import jobs
from pulsegrid.streaming.index import TraceIndex, in_file_order
from pulsegrid.streaming.report import Report
from pulsegrid.streaming.versions import Versions

TRACE = ("event_id", "sequence_index", "trace_id", "ros_time", "event_type", "source_topic", "source_node", "event_hash", "prev_event_hash")


def lines(spark: SparkSession, d: str, line, name: str) -> str:
    """A folder with one line of text per trace event: ``line`` of its columns."""
    folder = scratch(spark, name)
    trace_events(spark, d).select(line.alias("value")).write.text(folder)
    return folder


@query("SELECT CASE WHEN event_id % 50 = 3 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 50 = 3 THEN NULL WHEN event_id % 7 = 0 THEN 'UNKNOWN' ELSE 'n' || (user_id % 3) END AS source_node, count(*) AS lines, count(*) FILTER (event_id % 50 = 3) AS bad FROM events WHERE event_id % 60 <> 9 OR event_id % 50 = 3 GROUP BY 1, 2")
def trace_lines(spark, d):
    """S3: JSON lines with broken and blank ones; missing names get defaults."""
    i = F.col("sequence_index")
    node = F.when(i % 7 != 0, F.col("source_node"))
    line = F.when(i % 50 == 3, F.concat(F.lit("{broken "), i.cast("string"))).when(i % 60 == 9, "  ").otherwise(F.to_json(F.struct(*[c for c in TRACE if c != "source_node"], node.alias("source_node"))))
    e = tables.trace_jsonl(spark, lines(spark, d, line, "lines"))
    return e.groupBy("event_type", "source_node").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("_bad").isNotNull()).alias("bad"))


@query("SELECT CASE WHEN event_id % 40 = 1 THEN 'unreadable' WHEN event_id % 30 = 2 THEN 'event_id_missing' WHEN event_id % 20 = 4 THEN 'sequence_missing' WHEN event_id % 10 = 5 THEN 'event_hash_missing' ELSE 'taken' END AS code, count(*) AS lines, sum(CASE WHEN event_id % 40 = 1 OR event_id % 30 = 2 OR event_id % 20 = 4 OR event_id % 10 = 5 THEN 0 ELSE event_id END)::BIGINT AS sequences FROM events GROUP BY 1")
def strict_lines(spark, d):
    """JSON lines with short names; what breaks a rule is listed."""
    i = F.col("sequence_index")
    parts = [F.when(i % 30 != 2, F.col("event_id")).alias("event_id"), F.when(i % 20 != 4, i).alias("seq"), F.col("source_topic").alias("topic"), F.col("source_node").alias("node"), F.when(i % 10 != 5, F.col("event_hash")).alias("event_hash")]
    good, bad = tables.trace_jsonl_strict(spark, lines(spark, d, F.when(i % 40 == 1, "[1, 2").otherwise(F.to_json(F.struct(*parts))), "strict"))
    taken = good.select(F.lit("taken").alias("code"), F.col("sequence_index").alias("s"))
    return taken.union(bad.select("code", F.lit(0).cast("bigint"))).groupBy("code").agg(F.count(F.lit(1)).alias("lines"), F.sum("s").alias("sequences"))


@query("SELECT 'set_' || (user_id % 40) AS dataset_name, CASE WHEN user_id % 40 < 10 THEN 'incident' ELSE 'normal' END AS dataset_type, event_type AS topic, count(*) AS messages, sum(count(*)) OVER (PARTITION BY user_id % 40)::BIGINT AS message_count, (user_id % 40 + 1) * 10.0::DOUBLE AS duration_sec FROM events GROUP BY user_id % 40, event_type")
def dataset_files(spark, d):
    """Recording metadata in YAML, a folder a dataset."""
    k = F.col("user_id") % 40
    per = events(spark, d).groupBy(k.alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat(F.lit("  - topic_metadata: {name: "), F.col("event_type"), F.lit("}\n    message_count: "), F.col("n").cast("string"), F.lit("\n"))
    text = per.groupBy("k").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(entry)), "").alias("topics"))  # a row a topic
    body = F.concat(F.lit("rosbag2_bagfile_information:\n  message_count: "), F.col("total").cast("string"), F.lit("\n  duration: {nanoseconds: "), ((F.col("k") + 1) * 10 * schema.NS).cast("string"), F.lit("}\n  topics_with_message_count:\n"), F.col("topics"))
    folder = scratch(spark, "sets")
    write_files(text.select(F.concat(F.when(F.col("k") < 10, "incident").otherwise("usual"), F.lit("/set_"), F.col("k").cast("string"), F.lit("/metadata.yaml")).alias("name"), body.alias("content")), folder)
    found = tables.dataset_metadata(spark, folder)
    return found.select("dataset_name", "dataset_type", F.explode("topics").alias("topic", "messages"), "message_count", "duration_sec")


def corpus(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Result directories of twenty runs, written as their JSON files and read by the corpus scan."""
    m = messages(spark, d).drop("run_id").join(events(spark, d).select(F.col("event_id").alias("arrival_seq"), F.concat(F.lit("run_"), (F.col("user_id") % 20).cast("string")).alias("run_id")), "arrival_seq")
    w = windows.expected_counts(windows.observed_windows(m, W), W / schema.NS)
    profile = windows.run_profile(w)
    ranked = windows.top_windows(w, 3, score="gap_max")
    by_run = lambda rows, value: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", value)))))
    p = profile.groupBy("run_id").agg(by_run(profile, F.struct("count", "first_ns", "last_ns", "duration_ns", "avg_gap_ns", "max_gap_ns", "jitter_ns", "finalized_window_count")).alias("content"))
    each = ranked.groupBy("run_id", "topic").agg(F.array_sort(F.collect_list(F.struct("rank", "window", "start_ns", "end_ns", "count", "expected_count"))).alias("ws"))
    v = each.groupBy("run_id").agg(by_run(each, F.col("ws")).alias("content"))
    k = F.substring("run_id", 5, 20).cast("int")
    engine = F.struct(F.lit("pulsegrid").alias("name"), F.when(k % 3 != 0, "1.0").alias("version"))
    head = profile.groupBy("run_id").agg(F.sum("count").alias("total")).select("run_id", F.to_json(F.struct(F.concat(F.lit("b"), k.cast("string")).alias("report_bundle_id"), F.lit("timing").alias("schema_name"), F.when(k % 4 != 0, engine).alias("engine"), F.struct(F.lit("log").alias("semantics"), F.col("total").alias("total_messages_observed")).alias("extraction"), F.array(F.struct(F.lit("topic_profile.json").alias("path"), F.lit(3).alias("size_bytes"))).alias("artifacts"))).alias("content"))
    folder = scratch(spark, "corpus")
    files = [t.select(F.concat("run_id", F.lit(f"/{name}")).alias("name"), "content") for t, name in ((head, "report_manifest.json"), (p, "topic_profile.json"), (v, "evidence_windows.json"))]
    write_files(files[0].union(files[1]).union(files[2]), folder)
    return tables.bundle_corpus(spark, folder)


RUNS = M.replace("'r' || (user_id % 4)", "'run_' || (user_id % 20)")


@query(f"WITH {RUNS}, {window_sql(W)}, rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY gm DESC, w) AS rank FROM win), p AS (SELECT run_id, topic, sum(n)::BIGINT AS count, min(f) AS first_ns, max(l) AS last_ns FROM win GROUP BY 1, 2) SELECT p.run_id, p.topic, p.count, first_ns, last_ns, rank::INT AS rank, w AS window, n AS window_count FROM p JOIN rk USING (run_id, topic) WHERE rank <= 3")
def bundle_files(spark, d):
    """Result directories read into tables of runs, profiles and windows."""
    t = corpus(spark, d)
    w = t["windows"].select("run_id", "topic", "rank", "window", F.col("count").alias("window_count"))
    return t["profile"].select("run_id", "topic", "count", "first_ns", "last_ns").join(w, ["run_id", "topic"])


@query("SELECT 'run_' || (user_id % 20) AS run_id, 'b' || (user_id % 20) AS report_bundle_id, NULL::VARCHAR AS schema_name, CASE WHEN user_id % 20 % 4 <> 0 THEN 'pulsegrid' END AS engine_name, CASE WHEN user_id % 20 % 4 <> 0 AND user_id % 20 % 3 <> 0 THEN '1.0' END AS engine_version, count(*) AS total_messages_observed, count(DISTINCT event_type) AS topic_count FROM events GROUP BY user_id % 20")
def run_provenance(spark, d):
    """what runs say of where they come from; missing parts are null."""
    t = corpus(spark, d)
    return gate.provenance(t["runs"], t["profile"]).select("run_id", "report_bundle_id", F.col("bundle_schema.name").alias("schema_name"), F.col("engine.name").alias("engine_name"), F.col("engine.version").alias("engine_version"), "total_messages_observed", "topic_count")


@query(f"WITH {M}, {window_sql(W)} SELECT run_id, topic, count(*) AS windows, sum(n)::BIGINT AS messages FROM win GROUP BY 1, 2")
def report_sink(spark, d):
    """Profile and windows written by run, then read back."""
    w = windows.observed_windows(messages(spark, d), W)
    folder = scratch(spark, "report")
    tables.write_report(windows.run_profile(w), w.select("run_id", "topic", "window", "count"), folder)
    found = spark.read.parquet(f"{folder}/windows").groupBy("run_id", "topic").agg(F.count(F.lit(1)).alias("windows"))
    return spark.read.parquet(f"{folder}/profile").select("run_id", "topic", F.col("count").alias("messages")).join(found, ["run_id", "topic"])


@query("SELECT 'e' || event_id AS event_id, event_id AS sequence_index, event_type, sha256('e' || event_id) AS event_hash FROM events WHERE event_id BETWEEN 100 AND (SELECT max(event_id) // 2 FROM events)")
def trace_index(spark, d):
    """Trace events written sorted by sequence, then a range of them read."""
    folder, e = scratch(spark, "index"), trace_events(spark, d)
    tables.write_trace_index(e, folder, 8)
    half = e.agg(F.max("sequence_index")).first()[0] // 2
    return spark.read.parquet(folder).where(F.col("sequence_index").between(100, half)).select("event_id", "sequence_index", "event_type", "event_hash")


@query(f"WITH {M}, {gap_sql('run_id, topic', 'm')} SELECT run_id, topic, n AS count, f AS first_ns, l AS last_ns FROM g")
def json_export(spark, d):
    """A report as JSON, read back."""
    folder = scratch(spark, "json")
    tables.write_json(windows.run_profile(windows.observed_windows(messages(spark, d), W)).select("run_id", "topic", "count", "first_ns", "last_ns"), folder)
    return spark.read.schema("run_id string, topic string, count bigint, first_ns bigint, last_ns bigint").json(folder)


def _text(s: str) -> bytes:
    return struct.pack("<I", len(s.encode())) + s.encode()


def _record(op: int, body: bytes) -> bytes:
    return bytes([op]) + struct.pack("<Q", len(body)) + body


def recording(rows: list[tuple[str, int, int, int]], per_chunk: int = 500, form: str = "indexed") -> bytes:
    """Messages (topic, time, sequence, size) as an uncompressed recording: what the queries below read.

    The form is "indexed", or "loose" (no chunks and no summary), or "cut" (chunks, but the file ends behind the last).
    """
    topics = sorted({r[0] for r in rows})
    number = {t: i + 1 for i, t in enumerate(topics)}
    channels = b"".join(_record(mcap.CHANNEL, struct.pack("<HH", number[t], 0) + _text(t) + _text("json") + struct.pack("<I", 0)) for t in topics)
    message = lambda t, at, s, n: _record(mcap.MESSAGE, struct.pack("<HIQQ", number[t], s, at, at) + b"x" * n)
    parts, indexes = [mcap.MAGIC + _record(1, _text("") + _text(""))], []
    size = len(parts[0])
    if form == "loose":
        parts += [channels, *(message(*r) for r in rows)]
    for k in range(0, len(rows) if form != "loose" else 0, per_chunk):
        part = rows[k : k + per_chunk]
        plain = (channels if k == 0 else b"") + b"".join(message(*r) for r in part)
        low, high = min(r[1] for r in part), max(r[1] for r in part)
        chunk = _record(mcap.CHUNK, struct.pack("<QQQI", low, high, len(plain), 0) + _text("") + struct.pack("<Q", len(plain)) + plain)
        indexes.append(_record(mcap.CHUNK_INDEX, struct.pack("<QQQQI", low, high, size, len(chunk), 0) + struct.pack("<Q", 0) + _text("") + struct.pack("<QQ", len(plain), len(plain))))
        parts.append(chunk)
        size += len(chunk)
    if form == "cut":
        return b"".join(parts)
    end = _record(15, struct.pack("<I", 0))
    if form == "loose":
        return b"".join(parts) + end + _record(mcap.FOOTER, struct.pack("<QQI", 0, 0, 0)) + mcap.MAGIC
    statistics = _record(mcap.STATISTICS, struct.pack("<QHIIIIQQ", len(rows), 0, len(topics), 0, 0, len(indexes), min(r[1] for r in rows), max(r[1] for r in rows)) + struct.pack("<I", 0))
    return b"".join([*parts, end, channels, *indexes, statistics, _record(mcap.FOOTER, struct.pack("<QQI", size + len(end), 0, 0)), mcap.MAGIC])


def recordings_of(spark: SparkSession, d: str, forms: list[str]) -> str:
    """A folder of eight recordings of all messages, cut by time, in the forms in turn."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(zip(b.topic, b.log_time_ns, b.arrival_seq, b.message_size))
            yield pd.DataFrame({"name": [f"{rows[0][2]}.mcap"], "content": [recording(rows, form=forms[rows[0][2] % len(forms)])]}) if rows else pd.DataFrame({"name": [], "content": []})

    m = messages(spark, d).select("topic", "log_time_ns", "arrival_seq", "message_size").repartitionByRange(8, "log_time_ns").sortWithinPartitions("log_time_ns")
    folder = scratch(spark, "recordings")
    write_files(m.mapInPandas(each, "name string, content binary"), folder)
    return folder


@query(f"WITH {M}, x AS (SELECT * FROM m WHERE t >= {DAY0 + 48 * HOUR} AND t < {DAY0 + 480 * HOUR}) SELECT topic, count(*) AS count, min(t) AS first_ns, max(t) AS last_ns, sum(size)::BIGINT AS bytes, (SELECT count(*) FROM m)::BIGINT AS declared FROM x GROUP BY topic")
def recordings(spark, d):
    """Recordings read by their summaries, then by chunk; chunks out of range aren't opened."""
    t = mcap.tables(mcap.inspect(spark, recordings_of(spark, d, ["indexed"])))
    declared = t["files"].agg(F.sum("message_count").alias("declared"))
    found = mcap.messages(t["chunks"], t["channels"], DAY0 + 48 * HOUR, DAY0 + 480 * HOUR).groupBy("topic").agg(F.count(F.lit(1)).alias("count"), F.min("log_time_ns").alias("first_ns"), F.max("log_time_ns").alias("last_ns"), F.sum("message_size").alias("bytes"))
    return found.join(F.broadcast(declared), how="cross")  # one row


@query(f"WITH {M} SELECT topic, count(*) AS count, min(t) AS first_ns, max(t) AS last_ns, sum(size)::BIGINT AS bytes, sum(a)::BIGINT AS sequences FROM m GROUP BY topic")
def unindexed_recordings(spark, d):
    """Recordings without chunks, without an end, and whole ones, scanned in splits where no index covers them."""
    inspected = mcap.inspect(spark, recordings_of(spark, d, ["loose", "cut", "indexed"]))
    found = mcap.all_messages(inspected, split_bytes=1 << 16)
    return found.groupBy("topic").agg(F.count(F.lit(1)).alias("count"), F.min("log_time_ns").alias("first_ns"), F.max("log_time_ns").alias("last_ns"), F.sum("message_size").alias("bytes"), F.sum("sequence").alias("sequences"))


@query("SELECT 'r' || (event_id // 1000) AS path, CASE WHEN event_id // 1000 % 5 = 1 THEN 'prefix_changed' WHEN event_id // 1000 % 5 = 2 THEN 'truncated' WHEN event_id // 1000 % 5 = 3 THEN 'missing' ELSE 'ok' END AS status FROM events GROUP BY event_id // 1000")
def append_source_files(spark, d):
    """Q5: files that were indexed against the files now: gone, shorter, or with another first part."""
    i = F.col("sequence_index")
    per = trace_events(spark, d).groupBy(F.floor(i / 1000).alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("event_id", F.lit("\n")))), "").alias("content"))  # a thousand lines at most
    folders = [scratch(spark, name) for name in ("before", "now")]
    name = F.concat(F.lit("r"), F.col("k").cast("string")).alias("name")
    write_files(per.select(name, "content"), folders[0])
    k = F.col("k") % 5
    changed = F.when(k == 1, F.concat(F.lit("X"), F.expr("substr(content, 2)"))).when(k == 2, F.expr("substr(content, 1, length(content) - 1)")).when(k == 4, F.concat("content", F.lit("more\n"))).otherwise(F.col("content"))
    write_files(per.where(k != 3).select(name, changed.alias("content")), folders[1])
    listed = [spark.read.format("binaryFile").load(f).select("path", "length") for f in folders]
    bare = F.element_at(F.split("path", "/"), -1).alias("path")
    before = audit.file_prefixes(listed[0]).select(bare, F.col("size_bytes").alias("indexed_end"), "prefix_sha256", F.least("size_bytes", F.lit(1 << 20)).alias("prefix_bytes"))
    again = listed[1].withColumn("name", F.element_at(F.split("path", "/"), -1)).join(before.select(F.col("path").alias("name"), "prefix_bytes"), "name")
    now = audit.file_prefixes(again).select(bare, "size_bytes", "prefix_sha256")
    return audit.append_source(before, now)


@query("WITH s AS (SELECT max(event_id) // 6 + 1 AS n FROM events) SELECT 'e' || event_id AS event_id, event_id AS sequence_index, sha256('e' || event_id) AS event_hash, event_id // n AS file FROM events, s WHERE event_id // n < 4")
def append_ingest(spark, d):
    """ST6: files taken one a micro-batch, each whole or not at all; from the one with a broken link on none follows."""
    shared = scratch(spark, "ingest")
    i = F.col("sequence_index")
    size = trace_events(spark, d).agg(F.max("sequence_index")).first()[0] // 6 + 1
    e = trace_events(spark, d).select("event_id", "sequence_index", "event_hash", F.when(i == 4 * size + 5, "x").otherwise(F.col("prev_event_hash")).alias("prev_event_hash"), (i * 200).alias("byte_offset"), F.floor(i / size).cast("int").alias("file"))
    for k in range(6):  # read in the order of their times
        e.where(F.col("file") == k).coalesce(1).write.parquet(f"{shared}/in/f{k}")
    cols = "event_id string, sequence_index bigint, event_hash string, prev_event_hash string, byte_offset bigint, file int"
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{shared}/in")
    tails = "last_indexed_seq bigint, last_event_hash string, number bigint"
    spark.createDataFrame([], tails).write.parquet(f"{shared}/tail/none")

    def tail() -> DataFrame:
        return spark.read.schema(tails).option("recursiveFileLookup", True).parquet(f"{shared}/tail").orderBy(F.desc("number")).limit(1)

    def write(batch: DataFrame, new: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{shared}/events/{number}")
        new.withColumn("number", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{shared}/tail/{number}")

    jobs.append_ingest(stream, tail, write, lambda broken, number: broken.write.mode("overwrite").parquet(f"{shared}/rejected/{number}"), f"{shared}/checkpoint", "byte_offset").awaitTermination()
    return spark.read.schema(cols).option("recursiveFileLookup", True).parquet(f"{shared}/events").select("event_id", "sequence_index", "event_hash", F.col("file").cast("bigint").alias("file"))


def arrivals(df: DataFrame, order: str, files: int, folder: str, take: Callable[[DataFrame], StreamingQuery], per_batch: int = 1) -> None:
    """Lay ``df`` down in slices by ``order``; whenever one or more have come, ``take`` the stream of the folder, which goes on from its checkpoint.

    What has come since is one micro-batch, so a slice is written by as many tasks as it is read by, into any number of files.
    """
    size = df.agg(F.max(order)).first()[0] // files + 1
    stream = df.sparkSession.readStream.schema(df.schema).option("recursiveFileLookup", True)
    for k in range(0, files, per_batch):
        df.where((F.col(order) >= k * size) & (F.col(order) < min(k + per_batch, files) * size)).write.parquet(f"{folder}/f{k}")
        take(stream.parquet(folder)).awaitTermination()


def reported(spark: SparkSession, m: DataFrame, window_ns: int, k: int) -> Report:
    """The report of a stream of messages in three micro-batches."""
    folder = scratch(spark, "stream-report")
    report = Report(Versions(spark, f"{folder}/tables"), window_ns, 2 * HOUR, k)
    arrivals(m.select("run_id", "topic", "log_time_ns", "arrival_seq"), "arrival_seq", 3, scratch(spark, "arrivals"), lambda stream: report.run(stream, f"{folder}/checkpoint"))
    return report


@query(SQL["top_evidence"])
def stream_top_evidence(spark, d):
    """ST3, ST1, T1, T2: top windows and missing intervals kept in the state of a stream, at its end those of the batch."""
    ranked = rounded(reported(spark, messages(spark, d), HOUR, 5).finish()[1], "count_ratio", "score")
    return ranked.select("run_id", "topic", "window", "count", "expected_count", "count_ratio", "max_gap_ns", "jitter_ns", "score", "evidence_kind", "missing_window_count", "rank")


@query(f"WITH {DIS}, s AS (SELECT run_id, min_by(t, a) AS s FROM r2 GROUP BY 1) SELECT run_id, topic, count(*) AS received, count(*) FILTER (late) AS late_count, count(*) FILTER (ooo) AS out_of_order_count, count(*) FILTER (NOT late AND t < s) AS before_start_count FROM r2 JOIN s USING (run_id) GROUP BY 1, 2")
def stream_disorder(spark, d):
    """ST2, W4, W5: late rows of a stream against the run's largest time, whatever its micro-batches."""
    return reported(spark, schema.disordered(messages(spark, d)), 6 * HOUR, 1).counts()


#: Kinds, names and numbers of an index of events with gaps.
INDEX = """WITH e AS (SELECT event_id AS i, lag(event_id) OVER (ORDER BY event_id) AS p, event_type, '/' || event_type AS source_topic, 'n' || (user_id % 3) AS source_node FROM events WHERE event_id % 11 NOT IN (3, 4))
SELECT 'gap' AS kind, p || '-' || i AS name, i - p - 1 AS n FROM e WHERE i - p > 1 UNION ALL SELECT 'events', 'all', count(*) FROM e
UNION ALL SELECT 'event_type', event_type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'source_topic', source_topic, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'source_node', source_node, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'clock_domain', 'ROS', count(*) FROM e UNION ALL SELECT 'time_source', 'LOG', count(*) FROM e"""


def with_jumps(spark: SparkSession, d: str) -> DataFrame:
    """Trace events without some numbers, dealt to six files."""
    e = trace_events(spark, d).where("sequence_index % 11 not in (3, 4)")
    return e.withColumns({"byte_offset": F.col("sequence_index") * 200, "file": F.floor(F.col("sequence_index") / 500).cast("string")}).withColumn("file", F.lpad("file", 9, "0"))


def index_rows(e: DataFrame, gaps: DataFrame, counts: DataFrame) -> DataFrame:
    """An index's three tables in one shape."""
    gap = gaps.select(F.lit("gap").alias("kind"), F.concat(F.col("prev_sequence").cast("string"), F.lit("-"), F.col("next_sequence").cast("string")).alias("name"), F.col("gap_size").alias("n"))
    return gap.union(e.agg(F.lit("events").alias("kind"), F.lit("all").alias("name"), F.count(F.lit(1)).alias("n")).select("kind", "name", "n")).union(counts.select("category", "name", "n"))


@query(INDEX)
def trace_index_tables(spark, d):
    """Events, gaps and counts of an index, written, then read back."""
    folder = scratch(spark, "index")
    tables.write_index(in_file_order(with_jumps(spark, d), "file", "byte_offset", "at"), folder, 8, "at")
    return index_rows(*(spark.read.parquet(f"{folder}/{name}") for name in ("events", "gaps", "counts")))


@query(INDEX)
def append_index(spark, d):
    """ST6: the three tables kept up to date by appended files, several a micro-batch; jumps at their seams too."""
    folder, e = scratch(spark, "append-index"), with_jumps(spark, d)
    index = TraceIndex(Versions(spark, f"{folder}/tables"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema), strict=False)
    arrivals(e, "sequence_index", 4, scratch(spark, "appended"), lambda stream: index.run(stream, f"{folder}/checkpoint"), 2)
    return index_rows(index.events(), index.gaps(), index.counts())


@query("SELECT event_type AS topic, CASE WHEN event_type < 'p' THEN 'stated' ELSE 'unknown' END AS sensor_category, CASE WHEN event_type < 'p' THEN count(*) / 2592000.0::DOUBLE END AS expected_hz FROM events GROUP BY 1")
def topic_metadata_file(spark, d):
    """topics' stated rates from a JSON file, with what it leaves out."""
    folder = scratch(spark, "metadata")
    n = messages(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    entry = F.when(F.col("topic") < "p", F.struct(F.lit("stated").alias("sensor_category"), (F.col("n") / 2_592_000.0).alias("expected_hz"))).otherwise(F.struct(F.lit(None).cast("string").alias("sensor_category"), F.lit(None).cast("double").alias("expected_hz")))
    content = F.to_json(F.map_from_entries(F.collect_list(F.struct("topic", entry))))  # a row a topic
    write_files(n.agg(content.alias("content")).select(F.lit("topics.json").alias("name"), "content"), folder)
    return tables.topic_metadata(spark, folder)
