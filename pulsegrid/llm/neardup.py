"""Near copies by Order MinHash, verified by banded alignment.

Words are runs of letters a-z (A-Z lower-cased), digits and non-ASCII bytes; a k-mer is ``K`` consecutive words, or all
words of a shorter text. Documents with the same words are copies: one of each group, that with the least doc_id,
stands for it from there on.

Of each representative ``SKETCHES`` order-min-hashes are taken: k-mers are labelled with their occurrence number, a
hash picks the ``MINIMA`` least of them, and these are kept in the order of the text. Two texts agree in one with about
J ** MINIMA for a Jaccard similarity J, less where the order differs. At J = 0.8 about one pair in 100,000 agrees in none.

Texts that share a sketch are a bucket. Its members are compared with two of its own, the one that shares most buckets
with others and the least one. Members that are not linked with these after the first round get centres among
themselves in ``ROUNDS`` - 1 further ones, never one that the bucket has had. Members of several classes that are left
then, as where many texts share a long passage, are settled by an exact join on the rarest k-mers of each (a prefix
filter), so no pair of a bucket stays open. A pair is a link if the Jaccard similarity of its k-mer sets is at least
``SIMILARITY`` and the aligned words, by an edit distance within a band, at least ``ALIGNED``. Linked representatives
form classes; the class id is the least doc_id.

Null texts count as empty; texts without words are copies of each other if they are equal. Rows without doc_id get no
class. Rows that repeat a doc_id belong to one document: each gets a row, and any of its texts can link it. No column
but the two named ones is looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import by_chars, give_back, stored, unused
from pulsegrid.llm.decontaminate import TABLE
from pulsegrid.llm.graph import components

K = 5
SKETCHES = 16
MINIMA = 3
SIMILARITY = 0.8
ALIGNED = 0.6
ROUNDS = 2
SALTS = 16
#: Up to this many ids (8 bytes each) are sent to every task to pick texts; more are joined by a shuffle.
SENT_IDS = 500_000

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.array([int.from_bytes(hashlib.md5(b"sketch %d" % i).digest()[:8], "little") | 1 for i in range(256)], np.uint64)
#: A factor for each place in the order.
_ORDERED = _SEEDS[100:] * _Q
_powers = np.ones((2, 1), np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers_to(n: int) -> np.ndarray:
    """Powers of _P and of its inverse modulo 2**64."""
    global _powers
    if _powers.shape[1] < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        size = max(n, 1 << 17)
        _powers = np.stack([np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, p, np.uint64)])) for p in (_P, inverse)])
    return _powers


def normal(text: str | None) -> bytes:
    """The words, separated by single spaces."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(TABLE).split())


def word_hashes(words: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``normal``: differences of one running sum over all bytes."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(words, np.uint8)
    power = _powers_to(len(raw) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(raw * power[0, : len(raw)])])
    cut = np.flatnonzero(raw == 32)
    start, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(raw)]])
    return _mixed((total[end] - total[start]) * power[1, start] + (end - start).astype(np.uint64))


def kmer_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * _Q + words[i : n - k + 1 + i]
    return _mixed(out)


def sketches(kmers: np.ndarray, n: int = SKETCHES, minima: int = MINIMA) -> np.ndarray:
    """Order-min-hashes of a text's k-mers."""
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if not first.all():
        where = np.arange(len(kmers))
        occurrence = np.empty(len(kmers), np.uint64)
        occurrence[order] = where - np.maximum.accumulate(np.where(first, where, 0))
        kmers = _mixed(kmers + occurrence * _P)
    out = np.empty(n, np.uint64)
    for i in range(n):
        value = (kmers ^ _SEEDS[i]) * _Q
        value ^= value >> np.uint64(29)
        value *= _SEEDS[i]
        least = np.argpartition(value, minima)[:minima] if len(value) > minima else np.arange(len(value))
        least.sort()  # the order of the text
        out[i] = (kmers[least] * _ORDERED[: len(least)]).sum() ^ _SEEDS[i]
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of the k-mer sets of two texts, from their word hashes."""
    x, y = np.unique(kmer_hashes(a)), np.unique(kmer_hashes(b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance if it is at most ``most``, else ``most + 1``: a band of diagonals that widens with each edit.

    For each number of edits it keeps how far each diagonal of the band can reach.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    la, lb = len(a), len(b)
    if not la or not lb:
        return min(max(la, lb), most + 1)
    goal = lb - la
    if abs(goal) > most:
        return most + 1
    reach = np.array([-1], np.int64)  # of diagonals -d..d after d edits: rows of a done; before any edit diagonal 0 starts at 0
    for d in range(most + 1):
        if d == 0:
            reach = np.zeros(1, np.int64)
        else:
            none = np.full(1, -1, np.int64)
            wide = np.concatenate([none, none, reach, none, none])
            # from the diagonal before: a word of b inserted; from the same: replaced; from the next: a word of a dropped
            reach = np.maximum(np.maximum(wide[:-2], wide[1:-1] + (wide[1:-1] >= 0)), wide[2:] + (wide[2:] >= 0))
        diagonal = np.arange(-d, d + 1)
        reach = np.minimum(np.minimum(reach, la), lb - diagonal)
        live = np.flatnonzero((reach >= 0) & (reach + diagonal >= 0) & (reach < la) & (reach + diagonal < lb))
        while len(live):
            live = live[a[reach[live]] == b[reach[live] + diagonal[live]]]
            reach[live] += 1
            live = live[(reach[live] < la) & (reach[live] + diagonal[live] < lb)]
        if abs(goal) <= d and reach[goal + d] >= la:
            return d
    return most + 1


def linked(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, aligned: float = ALIGNED) -> bool:
    """Whether two texts, given by their word hashes, are near copies."""
    if jaccard(a, b) < similarity:
        return False
    longest = max(len(a), len(b))
    most = int(longest * (1 - aligned))
    return edit_distance(a, b, most) <= most


def _signed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, key of the exact words, and sketches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in by_chars(batches):
            keys, signs = [], []
            for text in texts:
                words = normal(text)
                keys.append(hashlib.md5(words or b"\0" + text.encode("utf-8", "replace")).digest())
                signs.append(sketches(kmer_hashes(word_hashes(words))).view(np.int64) if words else None)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], ["doc_id", "key", "signs"])
        give_back()

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return ids.mapInArrow(each, "doc_id long, key binary, signs array<long>")


def _word_arrays(docs: DataFrame, ids: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """node and its words' hashes, for the nodes in ``ids`` only."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, texts in by_chars(batches):
            yield pa.RecordBatch.from_arrays([nodes, pa.array([word_hashes(normal(t)).astype(np.uint32).tobytes() for t in texts], pa.binary())], ["node", "words"])
        give_back()

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    if ids.count() <= SENT_IDS:
        return texts.join(F.broadcast(ids), "node", "left_semi").mapInArrow(each, "node long, words binary")
    return texts.mapInArrow(each, "node long, words binary").join(ids, "node", "left_semi")


def _verified(pairs: DataFrame, arrays: DataFrame, similarity: float, aligned: float) -> DataFrame:
    """The pairs (a, b) that are links."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [linked(*(np.frombuffer(x, np.uint32).astype(np.uint64) for x in xs), similarity, aligned) for xs in zip(b.x, b.y)]
            yield b.loc[good, ["a", "b"]]
        give_back()

    with_a = pairs.join(arrays.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    return with_a.join(arrays.select(F.col("node").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y").mapInPandas(each, "a long, b long")


def _pairs(member: str, *centres: str):
    return F.explode(F.array_distinct(F.filter(F.array(*[F.struct(F.least(member, c).alias("a"), F.greatest(member, c).alias("b")) for c in centres]), lambda p: p["a"] < p["b"])))


def _apart(live: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold several classes, with their class (root) and that of the best member (top)."""
    here = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    here = stored(here, "members")
    top = here.groupBy("bucket").agg(F.max_by("root", F.struct("score", -F.col("node"))).alias("top"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return here.join(stored(top.select("bucket", "top"), "tops"), "bucket")


def _candidates(nodes: DataFrame, arrays: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of ``nodes`` (node, root) of different classes whose k-mer sets may be that similar; none is missed.

    Each set is put in one order, the k-mers that fewest sets hold first. Two sets that share enough have their first
    common k-mer early in both; how early, the larger and the smaller one's size tell.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(kmer_hashes(np.frombuffer(x, np.uint32).astype(np.uint64))).view(np.int64) for x in b.words]
            yield pd.DataFrame({"node": b.node, "root": b.root, "part": b.part, "size": [len(x) for x in sets], "kmers": sets})

    # a repeated doc_id may have several texts: each is a part of its own
    texts = nodes.join(arrays, "node").select("node", "root", F.xxhash64("words").alias("part"), "words").mapInPandas(each, "node long, root long, part long, size long, kmers array<long>")
    rows = stored(texts.select("node", "root", "part", "size", F.explode("kmers").alias("kmer")), "kmers")
    held = stored(rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 1"), "held-kmers")
    own = Window.partitionBy("node", "part")
    # k-mers of one set alone come first and need no row
    at = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("n", "kmer")) - 1
    least = lambda share: F.ceil(F.lit(share) * F.col("size") - 1e-6)
    first = rows.join(held, "kmer").withColumn("at", at).where((F.col("at") <= F.col("size") - least(similarity)) & (F.col("low") != F.col("high")))
    first = stored(first.select("kmer", "node", "root", "size", "at"), "first-kmers")
    small = first.where(F.col("at") <= F.col("size") - least(2 * similarity / (1 + similarity))).withColumnsRenamed({c: f"{c}_s" for c in ("node", "root", "size", "at")})
    common = F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("size_s")) - 1e-6
    near = (F.col("root") != F.col("root_s")) & (F.col("size_s") <= F.col("size")) & (F.least(F.col("size") - F.col("at"), F.col("size_s") - F.col("at_s")) >= common)
    return first.join(small, "kmer").where(near).select(F.least("node", "node_s").alias("a"), F.greatest("node", "node_s").alias("b")).distinct()


def links(docs: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, aligned: float = ALIGNED, rounds: int = ROUNDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Links (a, b) between representatives."""
    reps = signed.groupBy("key").agg(F.min("doc_id").alias("node"), F.any_value("signs").alias("signs")).where("signs is not null")
    rows = reps.select("node", F.posexplode("signs").alias("i", "sign")).select("node", F.xxhash64("i", "sign").alias("bucket"))
    rows = stored(rows, "buckets")
    # what is joined back to a bucket's members is stored first: Spark can then split a bucket that holds most rows
    sizes = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    live = stored(rows.join(sizes, "bucket"), "shared-buckets")
    score = stored(live.groupBy("node").agg(F.sum("n").alias("score")), "scores")
    live = stored(live.join(score, "node").select("bucket", "node", "score"), "scored-buckets")
    arrays = stored(_word_arrays(docs, score.select("node"), text_col, id_col), "words")
    most = lambda node: F.max_by(F.col(node), F.struct(F.col("score"), -F.col(node)))
    found = None
    tried = None
    roots = None
    for k in range(rounds):
        # after the first round: buckets that still hold several classes, and each member apart from the best one's
        here = live if k == 0 else _apart(live, roots)
        rest = here if k == 0 else here.where("root <> top")
        centres = stored(rest.groupBy("bucket").agg(most("node").alias("centre"), F.min("node").alias("least")), "centres")
        paired = here.join(centres, "bucket")
        pairs = paired.select(_pairs("node", "centre", "least").alias("p")).select("p.a", "p.b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        new = stored(_verified(pairs, arrays, similarity, aligned), "links")
        found = new if found is None else found.union(new)
        tried = pairs if tried is None else tried.union(pairs)
        # a centre has met its whole bucket
        live = stored(paired.where("node <> centre and node <> least").select("bucket", "node", "score"), "open-buckets")
        roots = components(found)
    left = stored(_apart(live, roots).select("node", "root").distinct(), "apart")
    if left.head(1):
        pairs = stored(_candidates(left, arrays, similarity).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = found.union(stored(_verified(pairs, arrays, similarity, aligned), "links"))
    return found


def classes(docs: DataFrame, similarity: float = SIMILARITY, aligned: float = ALIGNED, rounds: int = ROUNDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, copy_id (least doc_id with the same words) and class_id (least of its class)."""
    signed = stored(_signed(docs, text_col, id_col), "signed")
    roots = components(links(docs, signed, similarity, aligned, rounds, text_col, id_col)).withColumnsRenamed({"node": "copy_id", "root": "class_id"})
    copies = signed.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "copy_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = signed.select("doc_id", "key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    own = own.join(copies, ["key", "salt"], "left").select("doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"))
    # Only documents that stand for others or are linked have a row in roots; a hot one is spread by the salt again.
    salted = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["copy_id", "salt"], "left").select("doc_id", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"))
    missing = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("copy_id"), F.lit(None).cast("long").alias("class_id"))
    return out.union(missing)


def keep(docs: DataFrame, similarity: float = SIMILARITY, aligned: float = ALIGNED, rounds: int = ROUNDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each class, the one with the least doc_id, with its own columns; rows without doc_id stay."""
    found = stored(classes(docs, similarity, aligned, rounds, text_col, id_col), "classes")
    name = unused(docs.columns, "gone")
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
    sent = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    left = docs.join(sent, docs[id_col].cast("long") == F.col(name), "left_anti")
    repeated = found.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1")
    if not repeated.head(1):
        return left
    return left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(left.where(F.col(id_col).isNull()))
