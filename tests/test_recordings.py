"""Recordings with and without an index, cut, damaged, or with payloads that look like records: all messages are read."""

import random
import struct

import pytest

from pulsegrid.sources import mcap

TOPICS = ["/imu", "/gps", "/lidar"]


def text(s):
    return struct.pack("<I", len(s.encode())) + s.encode()


def record(op, body):
    return bytes([op]) + struct.pack("<Q", len(body)) + body


def channel(k):
    return record(mcap.CHANNEL, struct.pack("<HH", k + 1, 0) + text(TOPICS[k]) + text("json") + struct.pack("<I", 0))


def payload(r):
    """Noise, zeros, or bytes that are records themselves."""
    fake = record(mcap.MESSAGE, struct.pack("<HIQQ", 9, 9, 9, 9) + b"fake")
    return r.choice([bytes(r.randrange(256) for _ in range(r.randrange(60))), bytes(r.randrange(200)), fake * r.randrange(1, 40), b"\x05" + struct.pack("<Q", 30)])


def made(seed, n, chunked=(), channels="front", attachment=False):
    """Bytes of a recording without its end, its chunks' places, and its messages (topic, time, size)."""
    r = random.Random(seed)
    out, chunks, messages = mcap.MAGIC + record(1, text("") + text("x")), [], []
    if channels == "front":
        out += b"".join(channel(k) for k in range(3))
    held = b"".join(channel(k) for k in range(3)) if channels == "chunk" else b""
    for i in range(n):
        k, data = r.randrange(3), payload(r)
        held += record(mcap.MESSAGE, struct.pack("<HIQQ", k + 1, i, 1000 + i, 1000 + i) + data)
        messages.append((TOPICS[k], 1000 + i, len(data)))
        if not chunked:
            out, held = out + held, b""
        elif (i + 1) % 10 == 0 or i == n - 1:
            compression = chunked[(i // 10) % len(chunked)]
            packed = __import__("zstandard").ZstdCompressor().compress(held) if compression == "zstd" else held
            chunk = record(mcap.CHUNK, struct.pack("<QQQI", 1000 + i // 10 * 10, 1000 + i, len(held), 0) + text(compression) + struct.pack("<Q", len(packed)) + packed)
            chunks.append((1000 + i // 10 * 10, 1000 + i, len(out), len(chunk), compression, len(packed), len(held)))
            out, held = out + chunk, b""
        if attachment and i % 25 == 3 and not held:
            out += record(9, struct.pack("<QQ", 0, 0) + text("a") + text("b") + struct.pack("<Q", 3000) + bytes(3000) + struct.pack("<I", 0))
    return out, chunks, messages


def ended(data, chunks=(), n=0, channels=True, statistics=True):
    data += record(15, struct.pack("<I", 0))
    start = len(data)
    if channels:
        data += b"".join(channel(k) for k in range(3))
    for a, b, offset, length, compression, packed, plain in chunks:
        data += record(mcap.CHUNK_INDEX, struct.pack("<QQQQI", a, b, offset, length, 0) + struct.pack("<Q", 0) + text(compression) + struct.pack("<QQ", packed, plain))
    if statistics:
        data += record(mcap.STATISTICS, struct.pack("<QHIIIIQQ", n, 0, 3, 0, 0, len(chunks), 1000, 1000 + n - 1) + struct.pack("<I", 0))
    return data + record(mcap.FOOTER, struct.pack("<QQI", start if len(data) > start else 0, 0, 0)) + mcap.MAGIC


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files and the messages that each must give."""
    d, want = tmp_path_factory.mktemp("recordings"), {}

    def put(name, data, messages):
        (d / f"{name}.mcap").write_bytes(data)
        want[name] = sorted(messages)

    a, _, m = made(1, 400)
    put("unchunked_no_summary", ended(a, channels=False, statistics=False), m)
    put("unchunked_with_statistics", ended(a, n=400), m)
    put("no_end_at_all", a, m)
    put("cut_in_a_message", a[:-5], m[:-1])
    put("cut_in_a_header", a + b"\x05\x20\x00", m)
    b, chunks, m = made(2, 405, ("", "zstd"), "chunk")
    put("chunked_no_summary", ended(b, channels=False, statistics=False), m)
    put("indexed_channels_in_chunks", ended(b, chunks, 405, channels=False), m)
    put("cut_behind_chunks", b, m)
    c, chunks, m = made(3, 400, ("",), attachment=True)
    put("indexed", ended(c, chunks, 400), m)
    whole = c.rindex(record(mcap.MESSAGE, struct.pack("<HIQQ", TOPICS.index(m[-3][0]) + 1, 397, 1397, 1397))[:1] + struct.pack("<Q", 22 + m[-3][2]) + struct.pack("<HI", TOPICS.index(m[-3][0]) + 1, 397))
    put("cut_in_a_chunk", c[: whole + 10], m[:397])
    loose = b"".join(record(mcap.MESSAGE, struct.pack("<HIQQ", 1, i, 5000 + i, 0) + b"abc") for i in range(20))
    put("indexed_and_loose", ended(c + loose, chunks, 420), m + [("/imu", 5000 + i, 3) for i in range(20)])
    e, _, m = made(4, 300)
    at = e.index(record(mcap.MESSAGE, b"")[:1] + struct.pack("<Q", 22 + m[150][2]) + struct.pack("<HI", TOPICS.index(m[150][0]) + 1, 150))
    put("damaged", ended(e[:at] + b"\xff" * 0 + b"\x00" * 77 + e[at:], channels=False, statistics=False), m)
    put("empty", ended(mcap.MAGIC + record(1, text("") + text("x")), channels=False, statistics=False), [])
    (d / "no_recording.mcap").write_bytes(b"nothing")
    (d / "nothing.mcap").write_bytes(b"")
    want |= {"no_recording": [], "nothing": []}
    return str(d), want


@pytest.mark.parametrize("split", [64 << 20, 4096, 500])
def test_all_messages_of_all_files(spark, folder, split):
    found = {}
    for r in mcap.all_messages(mcap.inspect(spark, folder[0]), split_bytes=split).collect():
        found.setdefault(r.path.rsplit("/", 1)[1].removesuffix(".mcap"), []).append((r.topic, r.log_time_ns, r.message_size))
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in folder[1].items() if v}


def test_a_range_of_all_files(spark, folder):
    found = mcap.all_messages(mcap.inspect(spark, folder[0]), 1100, 1250, 2000).select("topic", "log_time_ns").collect()
    want = [(t, at) for ms in folder[1].values() for t, at, _ in ms if 1100 <= at < 1250]
    assert sorted(map(tuple, found)) == sorted(want)


def test_wrong_guesses_are_mended(spark, folder, monkeypatch):
    """Whatever a split takes for its first record, the scan is that from the start."""
    inspected = mcap.inspect(spark, folder[0])
    right = sorted(map(tuple, mcap.located(mcap.splits(inspected, 700)).select("path", "start", "first").collect()), key=str)
    monkeypatch.setattr(mcap, "CHAIN", 1)
    assert sorted(map(tuple, mcap.located(mcap.splits(inspected, 700)).select("path", "start", "first").collect()), key=str) == right
