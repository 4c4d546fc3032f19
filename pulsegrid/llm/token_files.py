"""Token ids on disk: frequency-ranked, byte-aligned, with separate control bytes.

Ids are replaced by their rank in the frequency order of the whole corpus, so that frequent ids take one byte. Four
ranks share one control byte, two bits each, that hold their lengths (1 to 4 bytes); data bytes follow apart. A table
with a row for each control byte turns a file's control bytes into all lengths at once, so decoding is array work.

A file: ``MAGIC``; uint32 documents; uint64 ids; int64 doc_ids; uint8 null flags of these; uint32 counts; control
bytes; data bytes; numbers are little-endian. Files hold documents in ascending doc_id order (nulls first; repeated
doc_ids stand beside each other) and end after the document that takes them past ``ids_per_file``.

Null texts count as empty: their document holds the end id alone. Texts of any length are encoded whole. Documents
with one doc_id follow each other by a hash of their ids, so where each starts doesn't depend on the run. An empty
table gives no files and no rows. No other column of the input is looked at, whatever its name.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import WHITE
from pulsegrid.llm.common import Known, by_chars, give_back, scratch, stored, trimmed
from pulsegrid.llm.files import opened, put

MAGIC = b"FVB1"
IDS_PER_FILE = 4_000_000
#: A worker forgets part of its remembered words and pieces beyond these numbers, and between tasks beyond the last.
WORDS, PIECES, IDLE = 250_000, 400_000, 150_000
#: What Python's split takes for white space but the tokenizer doesn't.
NOT_WHITE = "\x1c\x1d\x1e\x1f"
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> bytes:
    """Control bytes, then data bytes."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes() + ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks of ``pack``."""
    n_control = -(-n // 4)
    size = LENGTHS[data[:n_control]].ravel()[:n].astype(np.int64)
    rest = data[n_control:]
    start = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = size > k
        out[has] |= rest[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list, counts: list[int], ranks: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + np.uint32(len(doc_ids)).tobytes() + np.uint64(len(ranks)).tobytes()
    return head + np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.array(counts, "<u4").tobytes() + pack(ranks)


def parse(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, counts and ranks of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    d, n = int(np.frombuffer(data, "<u4", 1, 4)[0]), int(np.frombuffer(data, "<u8", 1, 8)[0])
    ids, null = np.frombuffer(data, "<i8", d, 16), np.frombuffer(data, np.uint8, d, 16 + 8 * d)
    counts = np.frombuffer(data, "<u4", d, 16 + 9 * d).astype(np.int64)
    return [None if z else int(i) for i, z in zip(ids, null)], counts, unpack(np.frombuffer(data, np.uint8, -1, 16 + 13 * d), n)


#: The steps before the model of which the word rules below are made: NFC, white space, lower case; then letters, single numerals, or marks.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
PIECE = regex.compile(r"\p{L}+|\p{N}|[^\p{L}\p{N}]+")
#: The same cut, but that numerals other than digits stay with letters; the second for texts with an underscore.
_HEAD = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|"
COARSE = re.compile(_HEAD + f"[^\\w{WHITE}]+").findall, re.compile(_HEAD + f"(?:[^\\w{WHITE}]|_)+").findall
#: Bytes (as Latin-1) to the characters that stand for them in byte-level vocabularies: printable ones themselves, others from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(PRINTABLE)))}


class Encoder:
    """The tokenizer's ids of texts, found once for each word, and once for each piece that its steps before the model cut.

    If these steps are ``STEPS``, none looks across white space: texts are put in lower case and cut here, and each new
    piece goes to the tokenizer's model alone. With any other steps, and for texts that hold a special token's sign,
    the whole tokenizer is used.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, "rb") as f:
            steps = json.load(f)
        self.by_piece = all(steps.get(k) == v for k, v in STEPS.items()) and steps.get("post_processor") is None and steps.get("truncation") is None
        self.signs = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.packed = {"<u2": "<%dH", "<u4": "<%dI"}[self.dtype]
        self.words, self.pieces = Known(self.word), Known(self.piece)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(self.packed % len(ids), *ids)

    def piece(self, piece: str) -> bytes:
        tokenize = self.model.tokenize
        if piece.isascii() and piece.isprintable():
            return self.pack([t.id for t in tokenize(piece)])
        return self.pack([t.id for p in PIECE.findall(piece) for t in tokenize(p.encode().decode("latin-1").translate(BYTE_CHARS))])

    def word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, COARSE["_" in word](word)))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            if not self.by_piece or any(sign in text for sign in self.signs):
                yield self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            if not text.isascii():
                text = normalize("NFC", text).replace("\u03a3", "\u03c3")  # lower case has no regard to a word's end
            text = text.lower()
            if any(c in text for c in NOT_WHITE):
                yield self.word(text)
            else:
                yield b"".join(map(self.words.__getitem__, text.split()))
            self.forget(WORDS, PIECES)

    def forget(self, words: int, pieces: int) -> None:
        """Keep at most so many: those that came first, as they come often."""
        trimmed(self.words, words)
        trimmed(self.pieces, pieces)

    def rest(self) -> None:
        self.forget(IDLE, IDLE)
        give_back()


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a worker one core
    return Encoder(path)


def encode(docs: DataFrame, path: str, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and ``ids`` (little-endian, as wide as the vocabulary needs), ``end_id`` last."""

    def each(batches: Iterator[tuple[pa.Array, list[str]]]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = encoder.pack([end_id])
        for doc_ids, texts in batches:
            ids = [i + end for i in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([len(i) // len(end) for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        encoder.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: each(by_chars(batches)), "doc_id long, n_tokens long, ids binary")


def frequencies(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """id and count over all documents; each task sends one row for each id that it saw."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for i in b.ids:
                total += np.bincount(np.frombuffer(i, kind), minlength=vocabulary) if len(i) > vocabulary else 0
            short = b"".join(i for i in b.ids if len(i) <= vocabulary)
            total += np.bincount(np.frombuffer(short, kind), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    return tokens.select("ids").mapInPandas(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


#: Tasks that write or read files at most; beyond that a task has several files, one after the other.
MOST_TASKS = 4096



def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, ids_per_file: int = IDS_PER_FILE, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, np.ndarray]:
    """Write the files of ``docs`` to ``folder``; gives the table of files (part, place, file, n_docs, n_ids) and the id of each rank.

    The rank table has a row for each id of the vocabulary at most, so it is sent to every task.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    vocabulary = max(_encoder(path).vocabulary, end_id + 1)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens = stored(encode(docs, path, end_id, text_col, id_col), "ids")
    counted = frequencies(tokens, vocabulary).toPandas().sort_values(["n", "id"], ascending=[False, True])
    id_of = np.concatenate([counted["id"].to_numpy(np.int64), np.setdiff1d(np.arange(vocabulary), counted["id"])]).astype(np.uint32)
    rank_of = np.empty(vocabulary, np.uint32)
    rank_of[id_of] = np.arange(vocabulary, dtype=np.uint32)
    ranks = docs.sparkSession.sparkContext.broadcast(rank_of)
    parts = min(MOST_TASKS, max(1, -(-int(counted["n"].sum()) // ids_per_file)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        part, place, ids, data, held = task.partitionId(), 0, [], [], 0

        def flush() -> pd.DataFrame:
            flat = np.frombuffer(b"".join(data), kind)
            name = f"part-{part:08d}-{place:06d}-{task.taskAttemptId()}.fvb"  # of two attempts, the table of files names those of one
            put(folder, name, file_bytes(ids, [len(x) // flat.itemsize for x in data], ranks.value[flat]))
            return pd.DataFrame({"part": [part], "place": [place], "file": [name], "n_docs": [len(ids)], "n_ids": [len(flat)]})

        for b in batches:
            for d, i in zip(b.doc_id.astype("Int64"), b.ids):
                ids.append(None if d is pd.NA else int(d))
                data.append(i)
                held += len(i)
                if held >= ids_per_file * np.dtype(kind).itemsize:
                    yield flush()
                    place, ids, data, held = place + 1, [], [], 0
        if ids:
            yield flush()

    order = ["doc_id", "tie", "ids"]
    files = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).select("doc_id", "ids").mapInPandas(each, "part int, place int, file string, n_docs long, n_ids long")
    return stored(files, "files"), id_of


def read(spark: SparkSession, folder: str, files: DataFrame, id_of: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ``ids`` (little-endian uint32) of every document, from the files that ``files`` names."""
    table = spark.sparkContext.broadcast(id_of.astype("<u4"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = opened(folder)
        for b in batches:
            for name, start in zip(b.file, b.file_start):
                with system.open_input_stream(f"{path}/{name}") as f:
                    docs, counts, ranks = parse(f.read())
                ends = np.cumsum(counts)
                ids = table.value[ranks]
                yield pd.DataFrame({"doc_id": pd.array(docs, dtype="Int64"), "start": start + ends - counts, "n_tokens": counts, "ids": [ids[e - c : e].tobytes() for e, c in zip(ends, counts)]})

    total = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = total.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(files.withColumn("inside", inside).join(before, "part").select("file", (F.col("before") + F.col("inside")).alias("file_start")), "starts")
    return starts.repartition(min(MOST_TASKS, max(1, starts.count()))).mapInPandas(each, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 1, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write, read back, and describe what was read: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    files, id_of = write(docs, folder, path, end_id, ids_per_file)
    return read(spark, folder, files, id_of).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
