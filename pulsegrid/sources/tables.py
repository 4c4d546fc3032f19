"""Scans and sinks: JSONL trace events, topic metadata, dataset metadata, bundle corpora, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.ordering import sequence_gaps
from pulsegrid.operators.trace import category_counts
from pulsegrid.schema import TOPIC_METADATA, TRACE_EVENTS

#: What the full scan puts where a field is missing. Fixed values.
DEFAULTS = {"trace_id": "UNKNOWN", "clock_domain": "MISSING", "time_source": "MISSING", "event_type": "UNKNOWN", "source_topic": "UNKNOWN", "source_node": "UNKNOWN"}


def message_timing(df: DataFrame) -> DataFrame:
    """Topic and times only; other columns aren't read from Parquet."""
    return df.select("run_id", "topic", "log_time_ns", "publish_time_ns", "arrival_seq")


def trace_jsonl(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """Trace events of JSON lines; ``_bad`` holds lines that don't parse; blank lines are skipped; missing names get defaults."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    schema = TRACE_EVENTS + ", _bad string"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = rows.select(F.col("value").alias("raw"), parsed.alias("e")).select("raw", "e.*")
    return out.withColumns({c: F.when(F.col("_bad").isNull(), F.coalesce(c, F.lit(v))) for c, v in (DEFAULTS if defaults is None else defaults).items()})


def trace_jsonl_strict(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events with the short names seq, topic and node also read, and the violations; a caller takes none of it if there is one."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", TRACE_EVENTS + ", seq bigint, topic string, node string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    e = rows.select(F.col("value").alias("raw"), parsed.alias("e")).select("raw", "e.*")
    e = e.withColumns({"sequence_index": F.coalesce("sequence_index", "seq"), "source_topic": F.coalesce("source_topic", "topic"), "source_node": F.coalesce("source_node", "node")})
    code = F.when(F.col("_bad").isNotNull(), "unreadable").when(F.col("event_id").isNull(), "event_id_missing").when(F.col("sequence_index").isNull(), "sequence_missing").when(F.col("event_hash").isNull(), "event_hash_missing")
    e = e.withColumn("code", code)
    return e.where("code is null").drop("seq", "topic", "node", "_bad", "code"), e.where("code is not null").select("raw", "code")


def whole_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """A row per file, its text in ``value``."""
    reader = spark.read.format("text").option("wholetext", True)
    if pattern is not None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.load(path)


def topic_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of topics, each with sensor_category and expected_hz, as rows; files are small dimension tables."""
    text = whole_files(spark, path)
    entries = F.explode(F.from_json("value", "map<string,struct<sensor_category:string,expected_hz:double>>")).alias("topic", "m")
    return text.select(entries).select("topic", F.coalesce("m.sensor_category", F.lit("unknown")).alias("sensor_category"), "m.expected_hz").to(spark.createDataFrame([], TOPIC_METADATA).schema)


def with_topic_metadata(messages: DataFrame, metadata: DataFrame) -> DataFrame:
    out = messages.join(metadata, "topic", "left")
    return out.withColumn("sensor_category", F.coalesce("sensor_category", F.lit("unknown")))


def dataset_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets from recording metadata in YAML below a folder; the parent folder names the dataset and whether it is an incident."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            rows = []
            for path, text in zip(b.path, b.value):
                info = (yaml.safe_load(text) or {}).get("rosbag2_bagfile_information") or {}
                topics = {t["topic_metadata"]["name"]: int(t["message_count"]) for t in info.get("topics_with_message_count", [])}
                custom = info.get("custom_data") or {}
                parts = path.rstrip("/").split("/")
                kind = "incident" if any("incident" in p.lower() for p in parts[-3:]) else "normal"
                rows.append((parts[-2], kind, path, int(info.get("message_count", 0)), info.get("duration", {}).get("nanoseconds", 0) / 1e9, topics, next((v for k, v in custom.items() if k.endswith("expected_topic")), None)))
            yield pd.DataFrame(rows, columns=["dataset_name", "dataset_type", "path", "message_count", "duration_sec", "topics", "declared_topic"])

    text = whole_files(spark, folder, "metadata.y*ml")
    return text.select("value", F.col("_metadata.file_path").alias("path")).mapInPandas(parse, "dataset_name string, dataset_type string, path string, message_count bigint, duration_sec double, topics map<string,bigint>, declared_topic string")


MANIFEST = "report_bundle_id string, generated_at string, schema_name string, schema_version string, bundle_schema struct<name:string,version:string>, engine struct<name:string,version:string>, source struct<format:string,file_name:string,file_size_bytes:bigint>, extraction struct<semantics:string,mode:string,timestamp_unit:string,window_sec:double,allowed_lateness_sec:double,top:int,total_messages_observed:bigint>, artifacts array<struct<path:string,role:string,media_type:string,size_bytes:bigint,hash:struct<algorithm:string,value:string>,source_of_truth:boolean>>"
PROFILE = "struct<count:bigint,first_ns:bigint,last_ns:bigint,duration_ns:bigint,avg_gap_ns:bigint,max_gap_ns:bigint,jitter_ns:bigint,expected_count_per_window:bigint,finalized_window_count:bigint,out_of_order_count:bigint,late_dropped_count:bigint,sensor_category:string,expected_count_source:string,expected_hz:double>"
WINDOW = "struct<window:bigint,start_ns:bigint,end_ns:bigint,count:bigint,expected_count:bigint,count_ratio:double,max_gap_ns:bigint,jitter_ns:bigint,score:double,evidence_kind:string,missing_window_count:bigint,previous_observed_ns:bigint,next_observed_ns:bigint>"


def bundle_corpus(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables runs, artifacts, profile and windows of all result directories below a folder; the directory's name is the run."""
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_id")
    read = lambda name: whole_files(spark, folder, name).select(run, "value")
    runs = read("report_manifest.json").select("run_id", F.from_json("value", MANIFEST).alias("m")).select("run_id", "m.*")
    profile = read("topic_profile.json").select("run_id", F.explode(F.from_json("value", f"map<string,{PROFILE}>")).alias("topic", "p")).select("run_id", "topic", "p.*")
    windows = read("evidence_windows.json").select("run_id", F.explode(F.from_json("value", f"map<string,array<{WINDOW}>>")).alias("topic", "ws")).select("run_id", "topic", F.posexplode("ws").alias("rank", "w")).select("run_id", "topic", (F.col("rank") + 1).alias("rank"), "w.*")
    artifacts = runs.select("run_id", F.explode("artifacts").alias("a")).select("run_id", "a.path", "a.role", "a.media_type", "a.size_bytes", F.col("a.hash.value").alias("sha256"), "a.source_of_truth")
    return {"runs": runs.drop("artifacts"), "artifacts": artifacts, "profile": profile, "windows": windows}


def write_report(profile: DataFrame, windows: DataFrame, folder: str, form: str = "parquet") -> None:
    """Profile and windows, by run."""
    for name, df in (("profile", profile), ("windows", windows)):
        df.write.mode("overwrite").partitionBy("run_id").format(form).save(f"{folder}/{name}")


def write_trace_index(events: DataFrame, folder: str, files: int) -> None:
    """Trace events sorted by sequence over a number of files, so that a range of them is few files and row groups."""
    events.repartitionByRange(files, "sequence_index").sortWithinPartitions("sequence_index").write.mode("overwrite").parquet(folder)


def write_index(events: DataFrame, folder: str, files: int, order: str) -> dict[str, int]:
    """Events, gaps and counts of a trace index, as tables below ``folder``; gives its totals.

    ``events`` (with ``order``, an integer that tells where a row stands) is read and sorted once, and its totals are
    taken while it is written; gaps and counts are made of the few columns of what was written that they need.
    """
    seen = Observation("trace-index")
    broken = F.count_if(F.col("_bad").isNotNull() if "_bad" in events.columns else F.lit(False))
    ordered = events.repartitionByRange(files, "sequence_index").sortWithinPartitions("sequence_index")
    # behind the shuffle, whose bounds take a look at all rows of their own
    counted = ordered.observe(seen, F.count(F.lit(1)).alias("events"), broken.alias("bad"), F.min("ros_time").alias("min_ros_time"), F.max("ros_time").alias("max_ros_time"))
    counted.write.mode("overwrite").parquet(f"{folder}/events")
    written = events.sparkSession.read.schema(events.schema).parquet(f"{folder}/events")
    sequence_gaps(written, order).write.mode("overwrite").parquet(f"{folder}/gaps")
    category_counts(written).write.mode("overwrite").parquet(f"{folder}/counts")
    return seen.get


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)
