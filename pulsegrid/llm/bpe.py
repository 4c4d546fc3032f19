"""Byte-level BPE encoding and decoding by longest-match backtracking.

The bytes of a piece are read as Latin-1 so that an Aho-Corasick automaton over the vocabulary finds every token that
occurs in it. From the left, the longest token that is compatible with the token before it is taken; where none fits,
the last choice is undone and its next shorter prefix is tried. Each position is given up at most once, so the work is
linear in the piece. Two adjacent tokens are compatible if merging their joint bytes by rank gives just these two. That
is read off the two edges that meet, as both tokens grow from bytes in the order of their ranks; answers are memoised. A sequence of which all neighbours are compatible is the one that the merges give.

Null texts count as empty (no ids). Very long texts and pieces are encoded whole. Rows are independent: repeated rows,
ties and an empty table need nothing special, and no column but the two named ones is looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Known, by_chars, give_back, trimmed

#: White space as Unicode has it. Fixed values.
WHITE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A text's stretches between which the splitting pattern never matches: white space ends a match except that a
#: single space goes with what follows it.
STRETCH = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Marks that the splitting pattern cuts, as one piece, from letters before them. (Of an apostrophe it may make a suffix.)
MARKS = ".,!?;:"
#: A worker forgets part of its remembered stretches and pieces beyond these numbers, and between tasks beyond the last; that bounds memory and changes no result.
STRETCHES, PIECES, IDLE = 250_000, 200_000, 30_000


class ByteBpe:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token.encode("latin-1")
        self.automaton = ahocorasick.Automaton()
        self.halves = {t: h for t in ranks if (h := self.last_merge(t)) is not None}
        self.reachable = {t for t in ranks if len(t) == 1 or t in self.halves}
        #: Tokens that come before one of their halves: their edges aren't in the order of ranks, so they are merged plainly.
        self.odd = {t for t, h in self.halves.items() if max(ranks[h[0]], ranks[h[1]]) >= ranks[t]}
        self.edges: dict[tuple[str, int], tuple[list[str], list[int]]] = {}
        for token in self.reachable:
            self.automaton.add_word(token, len(token))
        self.automaton.make_automaton()
        self.most = max(map(len, ranks))
        #: The longest token within each path of the automaton.
        self.within: dict[str, str] = {}
        for token in sorted(self.reachable, key=len):
            for n in range(1, len(token) + 1):
                path = token[:n]
                if path not in self.within or n == len(token):
                    self.within[path] = token if n == len(token) else self.within[path[:-1]]
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.reachable), None) for t in self.reachable}
        self.compatible = lru_cache(1 << 17)(self._compatible)
        self.cache, self.pieces = Known(self.encode_stretch), Known(self.encode_piece)

    @classmethod
    def from_file(cls, path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def merged(self, piece: str, until: int = 1) -> list[str]:
        """Plain merging by rank, for short pieces, until ``until`` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def last_merge(self, token: str) -> tuple[str, str] | None:
        """The two halves that merging ends with; None for bytes and for tokens that merging doesn't give."""
        parts = self.merged(token, 2)
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def edge(self, token: str, side: int) -> tuple[list[str], list[int]]:
        """The tokens at the right (1) or left (0) end of ``token`` as it grows from a byte, and the rank at which each goes on."""
        found = self.edges.get((token, side))
        if found is None:
            parts = [token]
            while len(parts[-1]) > 1:
                parts.append(self.halves[parts[-1]][side])
            parts.reverse()
            found = self.edges[token, side] = (parts, [self.ranks[t] for t in parts[1:]] + [1 << 60])
        return found

    def _compatible(self, left: str, right: str) -> bool:
        """Whether no merge across the boundary comes before those inside; of equal ranks the leftmost comes first."""
        if self.odd and (left in self.odd or right in self.odd):
            return self.merged(left + right) == [left, right]
        (ls, lr), (rs, rr) = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        ranks = self.ranks
        while True:
            across, a, b = ranks.get(ls[i] + rs[j]), lr[i], rr[j]
            if across is not None and across < a and across <= b:
                return False
            if a == b == 1 << 60:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the splitting pattern."""
        if not piece.isascii():
            piece = piece.encode("utf-8", "replace").decode("latin-1")
        if piece in self.ranks:
            return (self.ranks[piece],)
        dead: set[int] = set()
        chosen: list[str] = []
        shorter, compatible, within, prefix, most = self.shorter, self.compatible, self.within.get, self.automaton.longest_prefix, self.most
        size, at, undone = len(piece), 0, False
        while at < size:
            if not undone:  # the longest token that starts here, by the automaton's longest path
                near = piece[at : at + most]
                token = within(near[: prefix(near)])
            while token is not None and (at + len(token) in dead or chosen and not compatible(chosen[-1], token)):
                token = shorter[token]
            undone = token is None
            if token is not None:
                chosen.append(token)
                at += len(token)
            elif chosen:
                dead.add(at)
                token = chosen.pop()
                at -= len(token)
                token = shorter[token]
            else:
                raise ValueError("the vocabulary doesn't cover all bytes")
        return tuple([self.ranks[t] for t in chosen])

    def encode_stretch(self, stretch: str) -> tuple[int, ...]:
        core = stretch.rstrip(MARKS)
        if core[core[:1] == " " :].isalpha():
            pieces = [core, stretch[len(core) :]] if len(core) < len(stretch) else [core]
        else:
            pieces = self.split(stretch)
        return self.pieces[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text, stretch by stretch."""
        for text in texts:
            yield list(chain.from_iterable(map(self.cache.__getitem__, STRETCH.findall(text))))
            trimmed(self.cache, STRETCHES)
            trimmed(self.pieces, PIECES)

    def rest(self) -> None:
        """Keep little between tasks: what came first, as it comes often."""
        trimmed(self.cache, IDLE)
        trimmed(self.pieces, IDLE)
        self.compatible.cache_clear()
        give_back()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def _loaded(path: str, pattern: str) -> ByteBpe:
    """One per worker and vocabulary; the file is part of the installation on every machine."""
    return ByteBpe.from_file(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and ``ids`` (array of int), by the rank file at ``path``."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for doc_ids, texts in by_chars(batches):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(list(bpe.encode(texts)), pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ``bytes``, from doc_id and ``ids``."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _loaded(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "bytes": [bpe.decode(i) for i in b.ids]})

    return tokens.select("doc_id", "ids").mapInPandas(each, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoding, then decoding of the ids, in one pass over the texts."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        names = [str(i) for i in range(len(bpe.bytes_of))]
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for doc_ids, texts in by_chars(batches):
            out = [(len(ids), digest(" ".join(map(names.__getitem__, ids)).encode()), digest(bpe.decode(ids))) for ids in bpe.encode(texts)]
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(x) for x in zip(*out))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
