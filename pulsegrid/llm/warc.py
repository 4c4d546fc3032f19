"""Web archive files with an index: write once, then read selected records by byte range.

Each task writes its pages as gzip members, one a record, into archives of a bounded size, and gives an index row per
record: file, offset, length, URL and digest. Reading starts from index rows: those of a file are sorted by offset,
ranges that touch or lie close together become one read, and the records are cut out of it.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id is the response and
the others revisit it. Only digests that occur more than once are joined back, spread over ``SALTS`` keys each, so that
a payload that a third of all pages share is dealt to many tasks.

Null html counts as an empty payload, null urls as an empty target. Rows without a page_id never are a response that
others revisit; if all of a group are without, all are responses. Repeated rows with the largest page_id all are
responses. Payloads of any length are one record each. An empty table gives no archive and no row; no other column of
the input is looked at, whatever its name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import scratch, stored
from pulsegrid.llm.files import opened, put

SALTS = 16
FILE_BYTES = 32 << 20
#: Ranges of a file that lie at most this far apart are read together, up to READ_BYTES at once.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Tasks that read at most; beyond that a task has several stretches, one after the other.
MOST_TASKS = 4096
INDEX = "file string, offset long, length long, url string, digest string, page_id long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    """A record's bytes and its payload digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{i}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "X-Page-Id": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to), "X-Refers-To-Page": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", digest


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and ``refers_to``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # A digest of short payloads isn't grouped at all.
    long_enough = F.octet_length("html") >= least_bytes
    shared = own.where(long_enough).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    older = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return salted.join(shared, ["sha", "salt"], "left").select("page_id", "url", "html", F.when(long_enough & older, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write archives to ``folder``; gives the index, itself stored in the shared folder."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        place, held, size, rows = 0, [], 0, []
        # the index names the files of one attempt; another one's are never read
        named = lambda: f"part-{task.partitionId():08d}-{place:06d}-{task.taskAttemptId()}.warc.gz"
        name = named()
        for b in batches:
            for page, url, html, refers in zip(b.page_id.astype("Int64"), b.url, b.html, b.refers_to.astype("Int64")):
                page, refers = (None if x is pd.NA else int(x) for x in (page, refers))
                data, digest = record(page, url, html.encode("utf-8", "replace"), refers, date)
                member = gzip.compress(data, 4, mtime=0)
                held.append(member)
                rows.append((name, size, len(member), url, digest, page))
                size += len(member)
                if size >= file_bytes:
                    put(folder, name, b"".join(held))
                    yield index(rows)
                    place, held, size, rows = place + 1, [], 0, []
                    name = named()
        if rows:
            put(folder, name, b"".join(held))
            yield index(rows)

    def index(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file", "offset", "length", "url", "digest", "page_id"]).astype({"page_id": "Int64"})

    return stored(with_revisits(pages, least_bytes).mapInPandas(each, INDEX), "warc-index")


def runs(rows: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) ranges, joined into reads: start, end and the ranges of each."""
    held: list[tuple[int, int]] = []
    for offset, length in rows:
        if held and (offset - (held[-1][0] + held[-1][1]) > gap or offset + length - held[0][0] > most):
            yield held[0][0], held[-1][0] + held[-1][1], held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], held[-1][0] + held[-1][1], held


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of ``index`` name: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    The index is dealt out by file and stretch of ``READ_BYTES``, so a file's reads may go to several tasks.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(folder)
        for b in batches:
            for file, rows in b.sort_values(["file", "offset"]).groupby("file", sort=False):
                with system.open_input_file(f"{path}/{file}") as f:
                    for start, end, ranges in runs(list(zip(rows.offset, rows.length))):
                        f.seek(start)
                        data = f.read(end - start)
                        out = []
                        for offset, length in ranges:
                            head, payload = parse(gzip.decompress(data[offset - start : offset - start + length]))
                            whole = head["WARC-Type"] == "response"
                            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if whole and head["WARC-Payload-Digest"] != f"sha1:{digest}":
                                raise ValueError(f"{file} at {offset}: the payload doesn't have its digest")
                            number = lambda k: int(head[k]) if head.get(k) else None
                            out.append((number("X-Page-Id"), head["WARC-Target-URI"], head["WARC-Type"], number("X-Refers-To-Page"), head["WARC-Payload-Digest"][5:], len(payload) if whole else number("X-Payload-Length"), payload if whole else None))
                        yield pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    stretch = F.floor(F.col("offset") / READ_BYTES)
    # as many tasks as the archives' bytes ask for; the index rows themselves are too small to tell
    tasks = min(MOST_TASKS, 1 + (index.agg(F.sum("length")).first()[0] or 0) // READ_BYTES)
    dealt = index.select("file", "offset", "length").repartition(int(tasks), F.col("file"), stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(each, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages, read all records: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark: SparkSession = pages.sparkSession
    folder = scratch(spark, "warc")
    index = write(pages, folder, least_bytes)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
