"""Benchmark decontamination by Wu-Manber search over words.

A word is a run of bytes other than U+0000-2F, 3A-60 and 7B-7F once A-Z are lower-cased. The patterns are all windows
of ``width`` consecutive words of the items; an item of fewer words, but not none, is one pattern. Patterns of one
length share a table: for each block of two words it tells how far the search may move on before a pattern could end
with that block. Only where that is 0 are the patterns with this end, and this beginning, compared word by word.

The items are a query set that all documents are searched for. They go to the tasks in blocks of about ``block_chars``
characters (plus one item); a benchmark of one block is searched for in one pass, any other in a job per block, of
which only the hits are kept. So neither the driver nor a task holds more than a block.

Null texts have no words. A null item_id marks words but isn't named in the list of items; equal item_ids count as
one item. Repeated documents each get a row; texts of any length are searched whole; an empty benchmark or table gives
no hits or no rows; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import give_back, stored, unused

WIDTH = 10
BLOCK_CHARS = 400_000
#: Bytes of words to themselves, A-Z to a-z, all others to a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


class WuManber:
    """Patterns of one length ``m`` over words."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set]):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.buckets[p[m - self.block :]][p[: self.block]].append((list(p), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """Start and items of every occurrence, from the left."""
        m, far, shift, buckets = self.m, self.far, self.shift.get, self.buckets
        two = self.block == 2
        at, n = m - 1, len(words)
        while at < n:
            key = (words[at - 1], words[at]) if two else (words[at],)
            step = shift(key, far)
            if step:
                at += step
                continue
            start = at - m + 1
            for p, items in buckets[key].get(tuple(words[start : start + self.block]), ()):
                if words[start : at + 1] == p:
                    yield start, items
            at += 1


class Searcher:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = WIDTH):
        by_length: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            m = min(width, len(words))
            for i in range(len(words) - m + 1) if m else ():
                by_length[m][tuple(words[i : i + m])].add(item)
        self.tables = [WuManber(m, p) for m, p in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Stretches [start, end) of hit words, per pattern length from the left, and the items."""
        stretches, found = [], set()
        for t in self.tables:
            for start, items in t.search(words):
                found |= items
                if stretches and stretches[-1][0] <= start <= stretches[-1][1]:
                    stretches[-1] = (stretches[-1][0], max(stretches[-1][1], start + t.m))
                else:
                    stretches.append((start, start + t.m))
        return stretches, found


def covered(stretches: list[tuple[int, int]]) -> int:
    total, last = 0, 0
    for a, b in sorted(stretches):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


class Benchmark:
    """The items, each once, in blocks of a bounded size; the driver holds one block at a time."""

    def __init__(self, benchmark: DataFrame, block_chars: int, item_col: str, text_col: str):
        items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
        n = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
        self.n = 1 if n == 1 else 2 * int(n)
        self.items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)))

    def block(self, k: int) -> list[tuple]:
        return [tuple(r) for r in self.items.where(F.col("block") == k).select("item_id", "text").collect()]


def _verdict(n_words: int, spans: list[tuple[int, int]], items) -> tuple:
    named = ",".join(sorted(map(str, items)))
    spans = sorted(spans)
    return n_words, covered(spans), len(items), hashlib.sha256(named.encode()).hexdigest(), bool(spans), [{"start": s, "end": e} for s, e in spans]


VERDICT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"
_COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def _hits_by_text(texts: DataFrame, items: Benchmark, width: int) -> DataFrame:
    """Of the distinct texts (sha, text) those with hits, once per block that hits them: sha, spans, items.

    Each block is searched in a job of its own, whose hits are stored before the next block is fetched.
    """
    found = None
    for k in range(items.n):
        block = items.block(k)
        if not block:
            continue
        sent = texts.sparkSession.sparkContext.broadcast(block)

        def each(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            searcher = Searcher(sent.value, width)
            for b in batches:
                rows = [(sha, *searcher.hits(words_of(text))) for sha, text in zip(b.sha, b.text)]
                yield pd.DataFrame([(sha, [{"start": s, "end": e} for s, e in spans], sorted(i for i in found if i is not None)) for sha, spans, found in rows if spans], columns=["sha", "spans", "items"])

        hit = stored(texts.select("sha", "text").mapInPandas(each, "sha string, spans array<struct<start:int,end:int>>, items array<long>"), "hits")
        sent.destroy()
        found = hit if found is None else found.union(hit)
    if found is None:
        return texts.sparkSession.createDataFrame([], "sha string, spans array<struct<start:int,end:int>>, items array<long>")
    return found


def search(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_chars: int = BLOCK_CHARS, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and ``spans``: the hit stretches of words."""
    items = Benchmark(benchmark, block_chars, item_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if items.n == 1:
        sent = docs.sparkSession.sparkContext.broadcast(items.block(0))

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            searcher = Searcher(sent.value, width)
            for b in batches:
                out = []
                for words in map(words_of, b.text):
                    spans, found = searcher.hits(words)
                    out.append(_verdict(len(words), spans, found - {None}))
                frame = pd.DataFrame(out, columns=_COLUMNS)
                frame.insert(0, "doc_id", b.doc_id.to_numpy())
                yield frame
            give_back()

        return rows.mapInPandas(each, VERDICT)
    marked = rows.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    hits = _hits_by_text(marked, items, width).distinct().groupBy("sha").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "sha": b.sha, "n_words": [len(words_of(t)) for t in b.text]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_verdict(n, [(s["start"], s["end"]) for s in spans] if spans is not None else [], set(found) if found is not None else set()) for n, spans, found in zip(b.n_words, b.spans, b["items"])]
            frame = pd.DataFrame(out, columns=_COLUMNS)
            frame.insert(0, "doc_id", b.doc_id.to_numpy())
            yield frame

    return marked.mapInPandas(count, "doc_id long, sha string, n_words long").join(hits, "sha", "left").select("doc_id", "n_words", "spans", "items").mapInPandas(join, VERDICT)


def keep(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without any hit, with their own columns only."""
    items = Benchmark(benchmark, block_chars, item_col, item_text_col)
    if items.n == 1:
        return docs.where(_clean(docs.sparkSession.sparkContext.broadcast(items.block(0)), width)(F.col(text_col)))
    sha, name = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), unused(docs.columns, "hit")
    hit = _hits_by_text(docs.select(sha.alias("sha"), F.col(text_col).alias("text")), items, width).select(F.col("sha").alias(name)).distinct()
    return docs.join(hit, sha == F.col(name), "left_anti")


def _clean(sent, width: int):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(sent.value, width)
        for texts in batches:
            yield pd.Series([not any(next(t.search(w), None) for t in searcher.tables) for w in map(words_of, texts)], dtype=bool)
        give_back()

    return clean
