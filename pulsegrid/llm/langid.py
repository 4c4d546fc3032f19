"""Language identification by unigram pieces, summed over all segmentations.

Words are runs of letters, lower-cased, with a word-start mark before them. Each language has a probability for every
piece of a fixed public vocabulary; a word's likelihood is the sum over all ways to cut it into pieces of the product
of their probabilities, which the forward algorithm gives. Characters outside the vocabulary count the same in all
languages. The probabilities are fitted by expectation maximisation, whose expected piece counts come from the same
sums, on the words of a bounded sample of training rows: about ``SAMPLE_DOCS`` documents a language, picked by a hash of
doc_id, and of these the ``TRAIN_WORDS`` most frequent words. Languages are fitted apart, each by a task; all of them are
learnt. Up to ``HELD_LANGS`` go to every task at once; any further ones lie in the shared folder in blocks of so many,
which tasks read one after the other for each group of texts.

Only text and lang of rows whose crc32(doc_id) mod 5 isn't 0 are learnt from. A null text, or one without a letter, is
``und`` with score 0; so is every text if there is nothing to learn from. Numerals such as ½ or Ⅷ are no letters. Ties
go to the first language by name. Long texts are read whole, words of any length fitted and scored. Repeated rows are
judged one by one; other columns aren't looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import by_chars, give_back, held_out, scratch, stored, trimmed
from pulsegrid.shared import opened, write_files

SAMPLE_DOCS = 1500
TRAIN_WORDS = 12_000
ROUNDS = 3
#: Added to each expected count, and the probability of a character that no piece holds.
SMOOTH, UNKNOWN = 0.02, 1e-7
#: A worker forgets part of its scored words beyond this number.
REMEMBERED = 300_000
MARK = "▁"
#: Numerals that count as parts of words elsewhere, by the rule: alphanumeric, but neither letter nor decimal digit.
_NUMERALS = "".join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
WORD = re.compile(f"[^\\W\\d_{_NUMERALS}]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (general category L) in lower case; fitting and scoring use this one rule."""
    text = text.lower()
    found = WORD.findall(text)
    if len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text):  # the pattern leaves numerals beyond U+FFFF in words
        found = [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]
    return found


LONG = 40
#: Languages whose probabilities a task holds at a time (8 bytes a piece and language).
HELD_LANGS = 256


def vocabulary(path: str) -> list[str]:
    """Its pieces of letters, lower-cased, with or without the word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if WORD.fullmatch(p.removeprefix(MARK)) or p == MARK)


def automaton(pieces: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        found.add_word(p, (i, len(p)))
    found.make_automaton()
    return found


def lattice(words: ahocorasick.Automaton, word: str, unknown: int) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every piece in the marked word, by end; characters that no piece of one holds get ``unknown``."""
    marked = MARK + word
    edges = [(end + 1 - n, end + 1, i) for end, (i, n) in words.iter(marked)]
    single = {s for s, e, _ in edges if e == s + 1}
    if len(single) < len(marked):
        edges += [(i, i + 1, unknown) for i in range(len(marked)) if i not in single]
        edges.sort(key=lambda x: x[1])
    return edges


def log_sums(edges: list[tuple[int, int, int]], n: int, log_p) -> list[float]:
    """Logs of the sums over all paths from 0 to each position, for words of any length."""
    a = [-math.inf] * (n + 1)
    a[0] = 0.0
    for s, e, i in edges:
        x, y = a[e], a[s] + log_p[i]
        if y > x:
            x, y = y, x
        a[e] = x + math.log1p(math.exp(y - x)) if y > -math.inf else x
    return a


def forward(edges: list[tuple[int, int, int]], n: int, p: list[float]) -> float:
    """Log of the sum over all paths from 0 to n; of long words in logarithms."""
    if n > LONG:
        found = log_sums(edges, n, {i: math.log(p[i]) for _, _, i in edges})[n]
        return found if found > -math.inf else n * math.log(UNKNOWN)
    a = [0.0] * (n + 1)
    a[0] = 1.0
    for s, e, i in edges:
        a[e] += a[s] * p[i]
    return math.log(a[n]) if a[n] > 0 else n * math.log(UNKNOWN)


def expected(edges: list[tuple[int, int, int]], n: int, p: list[float], times: float, counts: list[float], log_p: list[float]) -> None:
    """Add ``times`` the expected number of uses of each piece in a word."""
    if n > LONG:
        back = sorted(((n - e, n - s, i) for s, e, i in edges), key=lambda x: x[1])
        a, b = log_sums(edges, n, log_p), log_sums(back, n, log_p)
        if a[n] > -math.inf:
            for s, e, i in edges:
                counts[i] += times * math.exp(a[s] + log_p[i] + b[n - e] - a[n])
        return
    a, b = [0.0] * (n + 1), [0.0] * (n + 1)
    a[0] = b[n] = 1.0
    for s, e, i in edges:
        a[e] += a[s] * p[i]
    if a[n] <= 0:
        return
    for s, e, i in sorted(edges, reverse=True):
        b[s] += p[i] * b[e]
    for s, e, i in edges:
        counts[i] += times * a[s] * p[i] * b[e] / a[n]


def fit(word_counts: dict[str, dict[str, float]], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages by name, and piece probabilities (pieces and the unknown one, languages)."""
    known = automaton(pieces)
    v = len(pieces)
    out = []
    for lang in sorted(word_counts):
        words = [(lattice(known, w, v), len(w) + 1, c) for w, c in word_counts[lang].items()]
        p = [1.0 / (v + 1)] * v + [UNKNOWN]
        for _ in range(rounds):
            counts = [SMOOTH] * (v + 1)
            log_p = [math.log(x) for x in p]
            for edges, n, c in words:
                expected(edges, n, p, c, counts, log_p)
            total = sum(counts[:v])
            p = [c / total for c in counts[:v]] + [UNKNOWN]
        out.append(p)
    return sorted(word_counts), np.array(out).T if out else np.zeros((v + 1, 0))


Block = tuple[list[str], np.ndarray, np.ndarray]


@dataclass
class Model:
    """Languages, piece probabilities and log priors, in blocks: the only one, or files of a folder."""

    pieces: list[str]
    blocks: int
    only: Block | None = None
    folder: str = ""

    def block(self, k: int) -> Block:
        if self.only is not None:
            return self.only
        system, path = opened(self.folder)
        with system.open_input_file(f"{path}/{k}.npz") as f, np.load(io.BytesIO(f.read())) as held:
            return held["langs"].tolist(), held["p"], held["prior"]


def _block(langs: list[str], p: list[bytes | None], n: list[int], total: int, pieces: int) -> Block:
    even = np.array([1.0 / pieces] * pieces + [UNKNOWN])  # no word of its sample was counted
    table = np.array([even if x is None else np.frombuffer(x) for x in p]).reshape(len(langs), pieces + 1)
    return langs, table.T, np.log(np.array(n, float) / total)


def train(docs: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS, train_words: int = TRAIN_WORDS, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", held_langs: int = HELD_LANGS) -> Model:
    """A model of the rows that aren't held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # a row a language
    sizes = stored(sizes.withColumn("block", F.floor((F.row_number().over(Window.orderBy("lang")) - 1) / held_langs).cast("int")), "languages")
    found = sizes.agg(F.sum("n").alias("total"), F.max("block").alias("last")).first()
    if found.total is None:
        return Model(pieces, 0)
    picked = rows.join(sizes.select("lang", "n"), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.ceil(1_000_003 * F.least(F.lit(1.0), sample_docs / F.col("n"))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for lang, text in zip(b["lang"], b.text):
                seen.update((lang, w) for w in words_of(text))
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in seen.items()], columns=["lang", "word", "n"])

    def fitted(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        _, p = fit({key[0]: dict(zip(b.word, b.n.astype(float)))}, pieces)
        return pd.DataFrame({"lang": [key[0]], "p": [np.ascontiguousarray(p[:, 0]).tobytes()]})

    counted = picked.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= train_words)
    models = sizes.join(top.orderBy("word").groupBy("lang").applyInPandas(fitted, "lang string, p binary"), "lang", "left")
    total, size = found.total, len(pieces)
    if found.last == 0:
        own = sorted(models.collect(), key=lambda r: r["lang"])  # HELD_LANGS rows at most
        return Model(pieces, 1, _block([r["lang"] for r in own], [r["p"] for r in own], [r["n"] for r in own], total, size))

    def packed(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b, out = b.sort_values("lang"), io.BytesIO()
        langs, p, prior = _block(b["lang"].tolist(), b.p.tolist(), b.n.tolist(), total, size)
        np.savez(out, langs=np.array(langs), p=p, prior=prior)
        return pd.DataFrame({"name": [f"{key[0]}.npz"], "content": [out.getvalue()]})

    folder = scratch(docs.sparkSession, "language-model")
    write_files(models.groupBy("block").applyInPandas(packed, "name string, content binary"), folder)
    return Model(pieces, found.last + 1, None, folder)


class Scorer:
    def __init__(self, pieces: list[str], langs: list[str], p: np.ndarray, prior: np.ndarray):
        self.known, self.langs, self.prior, self.unknown = automaton(pieces), langs, prior, len(pieces)
        self.p, self.table = [list(p[:, k]) for k in range(len(langs))], np.ascontiguousarray(p)
        self.single = {p for p in pieces if len(p) == 1}
        self.index: dict[str, int] = {}
        self.logs = np.zeros((1024, len(self.langs)))

    def learn(self, words: list[str]) -> None:
        """Score words of all languages: the forward sums of many words at once, one end position after the other."""
        k = len(self.index)
        while k + len(words) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        for j, w in enumerate(words):
            if len(w) >= LONG:
                edges = lattice(self.known, w, self.unknown)
                self.logs[k + j] = [forward(edges, len(w) + 1, p) for p in self.p]
        short = [(j, MARK + w) for j, w in enumerate(words) if len(w) < LONG]
        for at in range(0, len(short), 1000):
            group = short[at : at + 1000]
            edges: list[int] = []  # end, word, start and piece of each in one number, so that sorting goes by end and word
            for g, (_, w) in enumerate(group):
                base = g << 22
                edges += [end + 1 << 32 | base | end + 1 - n << 16 | i for end, (i, n) in self.known.iter(w)]
                if not self.single.issuperset(w):
                    edges += [i + 1 << 32 | base | i << 16 | self.unknown for i, c in enumerate(w) if c not in self.single]
            packed = np.sort(np.array(edges, np.int64))
            end, word, start, piece = packed >> 32, packed >> 22 & 1023, packed >> 16 & 63, packed & 65535
            lengths = np.array([len(w) for _, w in group])
            sums = np.zeros((len(group), lengths.max() + 1, len(self.langs)))
            sums[:, 0] = 1
            cut = np.searchsorted(end, np.arange(1, lengths.max() + 2))
            for e in range(1, lengths.max() + 1):
                rows = slice(cut[e - 1], cut[e])
                if rows.start < rows.stop:
                    first = np.flatnonzero(np.diff(word[rows], prepend=-1))
                    sums[word[rows][first], e] = np.add.reduceat(sums[word[rows], start[rows]] * self.table[piece[rows]], first, axis=0)
            found = sums[np.arange(len(group)), lengths]
            logs = np.where(found > 0, np.log(np.maximum(found, 1e-300)), lengths[:, None] * math.log(UNKNOWN))
            self.logs[[k + j for j, _ in group]] = logs
        self.index.update(zip(words, range(k, k + len(words))))

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float] | None]:
        """The best language of each text that has words, its log likelihood, and the sum of all likelihoods over its own."""
        out, held, size = [], [], 0
        for i, text in enumerate(texts):
            held.append(words_of(text or "") if self.langs else [])
            size += len(text or "")
            if size > 1 << 20 or i == len(texts) - 1:
                trimmed(self.index, REMEMBERED)  # rows of self.logs are given out in order, so the kept half is its first rows
                self.learn(sorted(set().union(*held).difference(self.index)))
                for words in held:
                    if not words:
                        out.append(None)
                        continue
                    total = self.prior + self.logs[list(map(self.index.__getitem__, words))].sum(axis=0)
                    best = int(np.argmax(total))
                    out.append((self.langs[best], float(total[best]), float(np.exp(total - total[best]).sum())))
                held, size = [], 0
        return out


def together(parts: list[list[tuple[str, float, float] | None]]) -> list[tuple[str, float]]:
    """Language and posterior of each text from what each block of languages says of it."""
    out = []
    for own in zip(*parts):
        if own[0] is None:
            out.append(("und", 0.0))
            continue
        lang, best, _ = max(own, key=lambda x: x[1])  # the first one of equals
        out.append((lang, 1 / sum(total * math.exp(top - best) for _, top, total in own)))
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        one = Scorer(model.pieces, *model.block(0)) if model.blocks == 1 else None
        for doc_ids, texts in by_chars(batches):
            parts = [one.judge(texts)] if one else [Scorer(model.pieces, *model.block(k)).judge(texts) for k in range(model.blocks)]
            found = together(parts) if parts else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "lang_pred", "score"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(each, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Train on the rows that aren't held out, then judge all rows."""
    pieces = vocabulary(path or public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, train(docs, pieces))
