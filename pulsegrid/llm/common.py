"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.shared import scratch, stored  # noqa: F401  (the operators here take them from this module)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text is a multiple of five (null ids: crc32 of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Known(dict):
    """What was found for each part of a text; what isn't known yet is asked for once."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, part: str):
        found = self[part] = self.find(part)
        return found


def trimmed(memory: dict, most: int) -> None:
    """Forget the later half of what ``memory`` holds once it is over ``most``: what came first is what comes often."""
    if len(memory) > most:
        for key in list(memory)[most // 2 :]:
            del memory[key]


def give_back() -> None:
    """Return freed memory to the system at a task's end, so that a worker that waits for its next one holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def by_chars(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of Arrow batches (id, text), null texts as empty ones, in groups that end once they hold ``most`` characters.

    Only a group's texts are Python strings at a time, however many rows a batch has.
    """
    for batch in batches:
        ids, column, first, texts, size = batch.column(0), batch.column(1), 0, [], 0
        for text in column:
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= most:
                yield ids.slice(first, len(texts)), texts
                first, texts, size = first + len(texts), [], 0
        if texts:
            yield ids.slice(first), texts


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
