"""Integrity of files, artifacts, records and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalar import canonical_json, json_text
from pulsegrid.shared import opened


def structural_audit(files: DataFrame, channels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Consistency of each file's terminal metadata, times and counts: ``warnings`` and status ok or degraded."""
    n = lambda t, name: t.groupBy("path").agg(F.count(F.lit(1)).alias(name))
    f = files.join(n(channels, "_channels"), "path", "left").join(n(chunks, "_chunks"), "path", "left").na.fill(0, ["_channels", "_chunks"])
    s, o, size = F.col("summary_start"), F.col("summary_offset_start"), F.col("size_bytes")
    rules: dict[str, Column] = {
        "SIZE_ZERO": size > 0,
        "SUMMARY_START_OUT_OF_FILE": (s == 0) | (s < size),
        "SUMMARY_OFFSET_OUT_OF_FILE": (o == 0) | (o < size),
        "SUMMARY_PRESENCE_MISMATCH": F.col("has_summary") == (s != 0),
        "SUMMARY_LAYOUT_INCONSISTENT": ((s == 0) & (o == 0)) | ((s > 0) & ((o == 0) | (o >= s))),
        "TIME_RANGE_INCONSISTENT": F.col("start_ns").isNull() | F.col("end_ns").isNull() | (F.col("end_ns") >= F.col("start_ns")),
        "CHANNEL_COUNT_MISMATCH": F.col("channel_count").isNull() | (F.col("channel_count") == F.col("_channels")),
        "CHUNK_COUNT_MISMATCH": F.col("chunk_count").isNull() | (F.col("chunk_count") == F.col("_chunks")),
    }
    out = f.withColumn("warnings", F.array_compact(F.array(*[F.when(~c, name) for name, c in rules.items()])))
    return out.select("path", "warnings", F.when(F.size("warnings") == 0, "ok").otherwise("degraded").alias("status"))


def group_digest(rows: DataFrame, keys: list[str], columns: list[str], name: str = "digest") -> DataFrame:
    """SHA-256 of a group's rows, whatever their order: each row's own digest, sorted and joined.

    A group is the declared parts of one file or run (channels, chunks, artifacts), not its messages.
    """
    row = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in columns])), 256)
    return rows.withColumn("_row", row).groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_row")), ""), 256).alias(name))


def same_contract(channels: DataFrame, columns: list[str], source: str = "run_id") -> DataFrame:
    """Each source's digest, and whether it equals that of the first one by name."""
    d = group_digest(channels, [source], columns)
    first = d.agg(F.min_by("digest", source).alias("_first"))
    return d.join(F.broadcast(first), how="cross").select(source, "digest", (F.col("digest") == F.col("_first")).alias("same"))  # one row


def bundle_identity(manifests: DataFrame, artifacts: DataFrame, fields: list[str]) -> DataFrame:
    """SHA-256 of the canonical JSON of a bundle's text fields and its artifacts by path: sorted keys, no blanks, ASCII."""
    part = canonical_json({"path": json_text(F.col("path")), "role": json_text(F.col("role")), "sha256": json_text(F.col("sha256")), "size_bytes": F.col("size_bytes").cast("string")})
    listed = artifacts.select("run_id", F.struct("path", part.alias("text")).alias("a")).groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["text"]), ",").alias("_artifacts"))
    out = manifests.join(listed, "run_id", "left")
    values = {f: F.coalesce(json_text(F.col(f)), F.lit("null")) for f in fields} | {"artifacts": F.concat(F.lit("["), F.coalesce("_artifacts", F.lit("")), F.lit("]"))}
    return out.select("run_id", F.sha2(canonical_json(values), 256).alias("identity"))


def artifact_integrity(declared: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("run_id", "path")) -> DataFrame:
    """Declared artifacts against actual ones (size_bytes, sha256): ok, missing, size_differs, hash_differs, undeclared."""
    k = list(keys)
    a = declared.select(*k, F.col("size_bytes").alias("_s"), F.col("sha256").alias("_h"), F.lit(True).alias("_d"))
    b = actual.select(*k, "size_bytes", "sha256", F.lit(True).alias("_a"))
    status = F.when(F.col("_d").isNull(), "undeclared").when(F.col("_a").isNull(), "missing").when(~F.col("_s").eqNullSafe(F.col("size_bytes")), "size_differs").when(~F.col("_h").eqNullSafe(F.col("sha256")), "hash_differs").otherwise("ok")
    return a.join(b, k, "full_outer").select(*k, status.alias("status"))


def actual_files(spark, folder: str) -> DataFrame:
    """path, size_bytes and sha256 of all files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_pins(members: DataFrame, manifests: DataFrame) -> DataFrame:
    """Whether the manifest of each member still has the SHA-256 that it was pinned with."""
    now = manifests.select(F.col("run_id").alias("report_bundle_id"), F.col("sha256").alias("_now"))
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("report_manifest_sha256"), "ok").otherwise("changed")
    return members.join(now, "report_bundle_id", "left").select("revision_id", "report_bundle_id", status.alias("status"))


def append_source(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Whether a source may be appended from: not shorter than indexed, and its first part unchanged.

    Both have a row per path: indexed_end and prefix_sha256, size_bytes and prefix_sha256.
    """
    now = current.select("path", "size_bytes", F.col("prefix_sha256").alias("_now"))
    status = F.when(F.col("size_bytes").isNull(), "missing").when(F.col("size_bytes") < F.col("indexed_end"), "truncated").when(F.col("_now") != F.col("prefix_sha256"), "prefix_changed").otherwise("ok")
    return stored.join(now, "path", "left").select("path", status.alias("status"))


def file_prefixes(files: DataFrame, most: int = 1 << 20) -> DataFrame:
    """path, size_bytes and prefix_sha256, over the first ``most`` bytes or the file's own ``prefix_bytes`` if there is such a column.

    ``files`` has path and length, as the binaryFile source lists them; only the prefix of a file is read, inside a task.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for path, n in zip(b.path, b.n):
                system, inner = opened(path)
                with system.open_input_stream(inner) as f:
                    found.append(hashlib.sha256(f.read(int(n))).hexdigest())
            yield pd.DataFrame({"path": b.path, "size_bytes": b.size_bytes, "prefix_sha256": found})

    n = F.least(F.col("length"), F.coalesce("prefix_bytes", F.lit(most)) if "prefix_bytes" in files.columns else F.lit(most))
    return files.select("path", F.col("length").alias("size_bytes"), n.cast("bigint").alias("n")).mapInPandas(each, "path string, size_bytes bigint, prefix_sha256 string")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def compression_sets(chunks: DataFrame, key: str = "path") -> DataFrame:
    return chunks.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("compression")), ",").alias("compressions"))


def artifact_totals(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("run_id").agg(F.count(F.lit(1)).alias("artifacts"), F.sum("size_bytes").alias("total_bytes"))


def reconciled(written: DataFrame, read: DataFrame) -> DataFrame:
    """Rows written against rows read."""
    a, b = written.agg(F.count(F.lit(1)).alias("written")), read.agg(F.count(F.lit(1)).alias("read"))
    return a.join(F.broadcast(b), how="cross").withColumn("equal", F.col("written") == F.col("read"))  # one row each


def report_consistency(reports: DataFrame) -> DataFrame:
    """Codes per evaluation of its pairwise reports (evaluation_id, generated_at, target_id, reference_id, compatible)."""
    s = reports.groupBy("evaluation_id").agg(F.count_distinct("generated_at").alias("times"), F.count_distinct("target_id").alias("targets"), F.count(F.lit(1)).alias("reports"), F.count_distinct("reference_id").alias("references"), F.bool_and("compatible").alias("compatible"))
    rules = {"times_differ": F.col("times") != 1, "targets_differ": F.col("targets") != 1, "reference_repeated": F.col("reports") != F.col("references"), "incompatible": ~F.col("compatible")}
    return s.select("evaluation_id", F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])), ",").alias("violations"))


def topic_state_violations(sides: DataFrame, fields: DataFrame) -> DataFrame:
    """Topics of a pair in more than one set, and compared topics that aren't common."""
    pair = ["reference_id", "target_id", "topic"]
    twice = sides.groupBy(*pair).count().where("count > 1").select(*pair, F.lit("in_two_sets").alias("code"))
    stray = fields.select(*pair).distinct().join(sides.where(F.col("side") == "common").select(*pair), pair, "left_anti").withColumn("code", F.lit("compared_not_common"))
    return twice.union(stray)
