"""MCAP recordings as tables: summaries by file, then messages by chunk where there is an index, else by splits.

The layout is that of the public MCAP format: records of an opcode byte, a 64-bit length and a body; a footer that
points to a summary with statistics, channels and chunk indexes. Payloads are never kept. Files are opened inside
tasks; a chunk is a row of its own, so that a large file is read by many tasks.

What no chunk index covers (files without a summary, cut files, messages outside chunks) is scanned record by record, in
splits that many tasks read. A record has no mark, so each split guesses its first record: an offset from which several
records follow one another. The guesses are then held against where the split before ends; a wrong one is scanned again
from there, so the result is that of one scan from the start, whatever payloads look like. Bytes that are no record are
passed over up to the next one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.shared import stored

MAGIC = b"\x89MCAP0\r\n"
FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, CHUNK_INDEX, STATISTICS = 2, 3, 4, 5, 6, 8, 11

FILES = "path string, size_bytes bigint, message_count bigint, channel_count bigint, chunk_count bigint, start_ns bigint, end_ns bigint, has_summary boolean, summary_start bigint, summary_offset_start bigint, summary_crc bigint"
CHANNELS = "channel_id int, schema_id int, topic string, message_encoding string, schema_name string, schema_encoding string"
CHUNKS = "chunk_id int, message_start_ns bigint, message_end_ns bigint, offset bigint, length bigint, compression string, compressed_size bigint, uncompressed_size bigint"
#: Bytes of the data section that no chunk index covers.
REST = "start bigint, stop bigint"
SUMMARY = f"{FILES}, rest array<struct<{REST.replace(' ', ':').replace(',:', ',')}>>, channels array<struct<{CHANNELS.replace(' ', ':').replace(',:', ',')}>>, chunks array<struct<{CHUNKS.replace(' ', ':').replace(',:', ',')}>>"
MESSAGES = "path string, chunk_id int, channel_id int, topic string, schema_id int, sequence bigint, log_time_ns bigint, publish_time_ns bigint, message_size bigint"


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 9 <= len(data):
        (n,) = struct.unpack_from("<Q", data, at + 1)
        yield data[at], data[at + 9 : at + 9 + n]
        at += 9 + n


def _text(body: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", body, at)
    return body[at + 4 : at + 4 + n].decode(), at + 4 + n


def channel(body: bytes) -> dict:
    number, schema = struct.unpack_from("<HH", body)
    topic, at = _text(body, 4)
    encoding, _ = _text(body, at)
    return {"channel_id": number, "schema_id": schema, "topic": topic, "message_encoding": encoding}


def summary(path: str, size: int) -> dict:
    """What a file's footer and summary say."""
    out = {"path": path, "size_bytes": size, "message_count": None, "channel_count": None, "chunk_count": None, "start_ns": None, "end_ns": None, "has_summary": False, "summary_start": 0, "summary_offset_start": 0, "summary_crc": 0, "rest": [{"start": len(MAGIC), "stop": size}], "channels": [], "chunks": []}
    tail = 9 + 20 + len(MAGIC)
    if size < len(MAGIC) + tail:
        return out
    with _open(path) as f:
        f.seek(size - tail)
        end = f.read(tail)
        if end[-len(MAGIC) :] != MAGIC or end[0] != FOOTER:
            return out
        start, offsets, crc = struct.unpack_from("<QQI", end, 9)
        out |= {"summary_start": start, "summary_offset_start": offsets, "summary_crc": crc, "has_summary": start != 0}
        if not 0 < start < size:
            return out
        f.seek(start)
        data = f.read(size - tail - start)
    schemas, covered = {}, []
    for op, body in records(data):
        if op == SCHEMA:
            name, at = _text(body, 2)
            schemas[struct.unpack_from("<H", body)[0]] = (name, _text(body, at)[0])
        elif op == CHANNEL:
            out["channels"].append(channel(body))
        elif op == CHUNK_INDEX:
            a, b, offset, length, n = struct.unpack_from("<QQQQI", body)
            (indexes,) = struct.unpack_from("<Q", body, 36 + n)  # past the message index offsets
            covered.append((offset, offset + length + indexes))
            compression, at = _text(body, 36 + n + 8)
            packed, plain = struct.unpack_from("<QQ", body, at)
            out["chunks"].append({"chunk_id": len(out["chunks"]), "message_start_ns": a, "message_end_ns": b, "offset": offset, "length": length, "compression": compression, "compressed_size": packed, "uncompressed_size": plain})
        elif op == STATISTICS:
            messages, _, channels, _, _, chunks, first, last = struct.unpack_from("<QHIIIIQQ", body)
            out |= {"message_count": messages, "channel_count": channels, "chunk_count": chunks} | ({"start_ns": first, "end_ns": last} if messages else {})
    out["rest"], upto = [], len(MAGIC)
    for a, b in [*sorted(covered), (start, start)]:
        if a > upto:
            out["rest"].append({"start": upto, "stop": a})
        upto = max(upto, b)
    for c in out["channels"]:
        c["schema_name"], c["schema_encoding"] = schemas.get(c["schema_id"], (None, None))
    return out


def inspect(spark: SparkSession, folder: str, pattern: str = "*.mcap") -> DataFrame:
    """A row per file with nested channels and chunks."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([summary(p, int(n)) for p, n in zip(b.path, b.length)])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return listed.mapInPandas(each, SUMMARY)


def tables(inspected: DataFrame) -> dict[str, DataFrame]:
    """files, channels and chunks."""
    part = lambda name: inspected.select("path", F.explode(name).alias("x")).select("path", "x.*")
    return {"files": inspected.drop("rest", "channels", "chunks"), "channels": part("channels"), "chunks": part("chunks")}


def _plain(compression: str, data: bytes, size: int) -> bytes:
    if compression in ("", None):
        return data
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if compression == "lz4":
        import pyarrow as pa

        return pa.decompress(data, decompressed_size=size, codec="lz4", asbytes=True)
    raise ValueError(f"unknown compression {compression}")


#: The shortest body of a record of each kind.
SHORTEST = {1: 8, FOOTER: 20, SCHEMA: 14, CHANNEL: 16, MESSAGE: 22, CHUNK: 40, 7: 6, CHUNK_INDEX: 64, 9: 36, 10: 48, STATISTICS: 46, 12: 8, 13: 20, 14: 17, 15: 4}
PRIVATE = 128
#: Bytes of a split, of what is read at once, and records that must follow a guessed one.
SPLIT, READ, CHAIN = 64 << 20, 1 << 16, 12


class Bytes:
    """Parts of a file, read in stretches."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.held = f, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.f.seek(at)
            self.at, self.held = at, self.f.read(max(n, READ))
        return self.held[at - self.at : at - self.at + n]

    def header(self, at: int) -> tuple[int, int] | None:
        """Opcode and length of the record here, or None if there can't be one."""
        head = self.get(at, 9)
        if len(head) < 9:
            return None
        op, n = struct.unpack("<BQ", head)
        return (op, n) if op >= PRIVATE or n >= SHORTEST.get(op, 1 << 63) else None


def _guess(b: Bytes, at: int, stop: int) -> int | None:
    """The first offset from ``at`` on from which ``CHAIN`` records follow one another, or fewer up to the end."""
    while at < stop:
        data = np.frombuffer(b.get(at, min(READ, b.size - at)), np.uint8)
        if len(data) < 9:
            return None
        n = len(data) - 8
        # a known opcode, and a length of less than 2**40
        likely = (data[:n] >= 1) & (data[:n] <= 15)
        for k in (6, 7, 8):
            likely &= data[k : k + n] == 0
        for o in np.flatnonzero(likely):
            start = here = at + int(o)
            if start >= stop:
                return None
            for k in range(CHAIN):
                if k and b.size - here < 9:  # the end, its mark, or a header that it cuts
                    return start
                h = b.header(here)
                # a record may be cut by the file's end, but not the first
                if h is None or h[0] >= PRIVATE or (here + 9 + h[1] > b.size and k == 0):
                    break
                here += 9 + h[1]
                if here > b.size:
                    return start
            else:
                return start
        at += n
    return None


def walk(b: Bytes, at: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """Opcode, start of the body and its length for all records that start from ``at`` to ``stop``; the last is (0, end, 0).

    A record that the file's end cuts has the length that is there.
    """
    while at < stop:
        if at == b.size - len(MAGIC) and b.get(at, len(MAGIC)) == MAGIC:
            at = b.size
            break
        h = b.header(at)
        if h is None or (at + 9 + h[1] > b.size and h[0] not in (CHUNK, MESSAGE)):
            found = _guess(b, at + 1, stop)
            at = stop if found is None else found
            if found is None:
                break
            continue
        yield h[0], at + 9, min(h[1], b.size - at - 9)
        at = min(at + 9 + h[1], b.size)
    yield 0, at, 0


_SPLITS = "path string, size_bytes bigint, stretch bigint, split bigint, start bigint, stop bigint"
_FOUND = f"{_SPLITS}, first bigint, last bigint"


def splits(inspected: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """What no chunk index covers, in splits; each stretch starts with a record."""
    each = inspected.select("path", "size_bytes", F.explode("rest").alias("r")).select("path", "size_bytes", F.col("r.start").alias("stretch"), F.col("r.stop").alias("to")).where("to > stretch")
    cut = each.withColumn("start", F.explode(F.sequence("stretch", F.col("to") - 1, F.lit(split_bytes).cast("bigint"))))
    return cut.select("path", "size_bytes", "stretch", F.floor((F.col("start") - F.col("stretch")) / split_bytes).cast("bigint").alias("split"), "start", F.least(F.col("start") + split_bytes, "to").alias("stop"))


def located(cut: DataFrame) -> DataFrame:
    """The splits with their first record, null if none starts in them; a job a round, the second only after wrong guesses. Stored."""

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            firsts, lasts = [], []
            for r in rows.itertuples(index=False):
                with _open(r.path) as f:
                    b = Bytes(f, int(r.size_bytes))
                    first = int(r.first) if not pd.isna(r.first) else int(r.start) if r.split == 0 else _guess(b, int(r.start), int(r.stop))
                    last = None
                    if first is not None:
                        for _, last, _ in walk(b, first, int(r.stop)):
                            pass
                firsts.append(first)
                lasts.append(last)
            yield rows.assign(first=pd.array(firsts, "Int64"), last=pd.array(lasts, "Int64"))

    def stitched(rows: pd.DataFrame) -> pd.DataFrame:
        """One row a split: each must start where the one before ends; else it is to be scanned again from there.

        Those behind one that has no end yet are looked at in the next round.
        """
        rows = rows.sort_values("split")
        at, firsts, again = int(rows.stretch.iloc[0]), [], []
        for r in rows.itertuples(index=False):
            first = None if pd.isna(r.first) else int(r.first)
            if at is None:
                firsts.append(first)
                again.append(False)
                continue
            none = at >= r.stop
            again.append(not none and first != at)
            firsts.append(None if none else at)
            if not none:
                at = None if pd.isna(r.last) else int(r.last)
        return rows.assign(first=pd.array(firsts, "Int64"), again=again)

    found = cut.withColumn("first", F.lit(None).cast("bigint")).repartition("path", "split").mapInPandas(bounds, _FOUND)
    while True:
        found = stored(found.groupBy("path", "stretch").applyInPandas(stitched, f"{_FOUND}, again boolean"), "splits")
        wrong = found.where("again").drop("again", "last")
        if not wrong.head(1):
            return found.drop("again", "last")
        found = found.where("not again").drop("again").unionByName(wrong.repartition("path", "split").mapInPandas(bounds, _FOUND))


def _salvaged(compression: str, data: bytes) -> bytes:
    """What can be had of a chunk that is cut: nothing of one that can only be unpacked whole."""
    if not compression:
        return data
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return b""


_ROWS = "path string, chunk_id int, channel_id int, sequence bigint, log_time_ns bigint, publish_time_ns bigint, message_size bigint, topic string, schema_id int"
#: Rows that are handed on at once.
HANDED = 50_000


class _Rows:
    """Messages and channels of records, as rows of one table: a channel's has a topic and no time."""

    def __init__(self, path: str, start_ns: int | None, end_ns: int | None):
        self.path, self.start, self.end, self.rows = path, start_ns, end_ns, []

    def add(self, op: int, body: bytes, chunk: int | None) -> None:
        if op == MESSAGE and len(body) >= 22:
            number, sequence, at, published = struct.unpack_from("<HIQQ", body)
            if (self.start is None or at >= self.start) and (self.end is None or at < self.end):
                self.rows.append((self.path, chunk, number, sequence, at, published, len(body) - 22, None, None))
        elif op == CHANNEL:
            c = channel(body)
            self.rows.append((self.path, chunk, c["channel_id"], None, None, None, None, c["topic"], c["schema_id"]))

    def add_chunk(self, body: bytes, chunk: int | None) -> None:
        if len(body) < 40:
            return
        (plain,) = struct.unpack_from("<Q", body, 16)
        compression, at = _text(body, 28)
        (n,) = struct.unpack_from("<Q", body, at)
        data = body[at + 8 : at + 8 + n]
        for op, inner in records(_plain(compression, data, plain) if len(data) == n else _salvaged(compression, data)):
            if op != MESSAGE or len(inner) >= 22:
                self.add(op, inner, chunk)

    def taken(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _ROWS.split(", ")], dtype=object)


def _of_chunks(chunks: DataFrame, channels: DataFrame, start_ns: int | None, end_ns: int | None) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, number, offset, length in zip(b.path, b.chunk_id, b.offset, b.length):
                with _open(path) as f:
                    f.seek(offset + 9)
                    out = _Rows(path, start_ns, end_ns)
                    out.add_chunk(f.read(length - 9), number)
                yield out.taken()

    inside = F.lit(True)
    if start_ns is not None:
        inside &= F.col("message_end_ns") >= start_ns
    if end_ns is not None:
        inside &= F.col("message_start_ns") < end_ns
    # where the summary names no channels, they stand in chunks, maybe in others than their messages
    named = channels.select("path").distinct().withColumn("_named", F.lit(True))
    chunks = chunks.join(named, "path", "left").where(inside | F.col("_named").isNull())
    return chunks.select("path", "chunk_id", "offset", "length").repartition("path", "chunk_id").mapInPandas(each, _ROWS)


def _of_splits(found: DataFrame, start_ns: int | None, end_ns: int | None) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                with _open(r.path) as f:
                    b, out = Bytes(f, int(r.size_bytes)), _Rows(r.path, start_ns, end_ns)
                    for op, at, n in walk(b, int(r.first), int(r.stop)):
                        if op == CHUNK:
                            out.add_chunk(b.get(at, n), None)
                        elif op in (MESSAGE, CHANNEL):
                            if at + n < b.size or b.header(at - 9) == (op, n):  # else the file's end cuts it
                                out.add(op, b.get(at, n), None)
                        if len(out.rows) >= HANDED:
                            yield out.taken()
                yield out.taken()

    return found.where("first is not null").repartition("path", "stretch", "split").mapInPandas(each, _ROWS)


def _with_topics(rows: DataFrame, channels: DataFrame) -> DataFrame:
    """Messages of ``rows`` with the topics that ``channels`` or rows of channels give; one whose channel stands nowhere has none."""
    own = rows.where("topic is not null").select("path", "channel_id", "topic", "schema_id")
    every = channels.select("path", "channel_id", "topic", "schema_id").union(own).groupBy("path", "channel_id").agg(F.min(F.struct("topic", "schema_id")).alias("c")).select("path", "channel_id", "c.topic", "c.schema_id")
    return rows.where("log_time_ns is not null").drop("topic", "schema_id").join(every, ["path", "channel_id"], "left")


def messages(chunks: DataFrame, channels: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """The messages of the range in indexed chunks; chunks outside it aren't opened if the summary names channels."""
    return _with_topics(stored(_of_chunks(chunks, channels, start_ns, end_ns), "messages"), channels)


def all_messages(inspected: DataFrame, start_ns: int | None = None, end_ns: int | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """All messages of the range: indexed chunks by their index, everything else by a scan."""
    t = tables(inspected)
    rows = _of_chunks(t["chunks"], t["channels"], start_ns, end_ns).union(_of_splits(located(splits(inspected, split_bytes)), start_ns, end_ns))
    return _with_topics(stored(rows, "messages"), t["channels"])
