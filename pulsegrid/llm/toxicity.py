"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are densities of a lexicon that is itself learnt (words, and the first five and four letters of longer
words, with their log odds among toxic rows), how near its words stand to second-person words, and the rates of
capitals, punctuation and obfuscated words. Lexicon, trees and calibration are fitted on at most about ``SAMPLE``
labelled rows, picked by a hash of doc_id, whose crc32(doc_id) mod 5 isn't 0. They are split into two halves: features
of one half use the other half's lexicon, and calibration uses scores of trees that didn't see the row.

Null texts count as empty; empty texts get the score of their features like any other. Labels without doc_id or toxic
are left out, of repeated labels the largest holds. With no label of both kinds, all scores are 0. Repeated rows are
scored one by one, texts of any length whole; source, lang and doc_id are no inputs, other columns aren't looked at,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import held_out, stored

SAMPLE = 12_000
#: Lexicon terms: in at least so many toxic rows, with log odds of at least LEAST; the most frequent ENTRIES of these.
LEAST_ROWS, LEAST, ENTRIES = 3, 1.0, 20_000
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 32, 10
WORD = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_][*@$#0-9!]+[^\W\d_]")
REPEATED = re.compile(r"[!?.,]{2,}")
#: Second-person words of the four languages. Fixed values.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú usted ustedes vosotros tus vuestro vuestra".split())
NEAR = 3


def terms(word: str) -> tuple[str, ...]:
    n = len(word)
    return (word, "5" + word[:5], "4" + word[:4]) if n > 5 else (word, "4" + word[:4]) if n > 4 else (word,)


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    out = [math.log1p(len(words))]
    get = lexicon.get
    weights: dict[str, tuple[float, float, float]] = {}
    sums, tops, counts = [0.0] * 3, [0.0] * 3, [0] * 3
    for word, times in Counter(words).items():
        found = (get(word, 0.0), get("5" + word[:5], 0.0) if len(word) > 5 else 0.0, get("4" + word[:4], 0.0) if len(word) > 4 else 0.0)
        if found != (0.0, 0.0, 0.0):
            weights[word] = found
            for k in range(3):
                if found[k]:
                    sums[k] += times * found[k]
                    counts[k] += times
                    tops[k] = max(tops[k], found[k])
    strong = {w for w, f in weights.items() if max(f) >= 2.0}
    hits = [i for i, w in enumerate(words) if w in strong] if strong else []
    for k in range(3):
        out += [sums[k] / n, tops[k], counts[k] / n]
    near = sum(any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    letters = sum(map(len, words))
    upper = sum(1 for c in text if c.isupper()) if not text.islower() else 0
    shouted = sum(1 for w in text.split() if len(w) > 1 and w.isupper()) if upper > 0.1 * letters else 0
    marks = len(text) - letters - text.count(" ")
    return out + [len(hits) / n, math.log1p(len(hits)), math.log1p(len(strong)), near / n, sum(w in SECOND for w in words) / n, upper / max(1, letters), shouted / n, text.count("!") / n, text.count("?") / n, marks / n, (len(OBFUSCATED.findall(text)) + len(REPEATED.findall(text))) / n]


def _lexicon(rows: list[tuple[str, int, int]], positive: int, negative: int) -> dict[str, float]:
    """Log odds of terms, from (term, toxic rows, other rows)."""
    found = {}
    for term, p, q in rows:
        weight = math.log((p + 0.5) / (positive + 1)) - math.log((q + 0.5) / (negative + 1))
        if p >= LEAST_ROWS and weight >= LEAST:
            found[term] = weight
    return found


class Trees:
    """Boosted trees for the logistic loss over binned features; all nodes of a level are found together."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._binned(x)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(rate / (1 - rate))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            tree = self._tree(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            total += self._leaf(binned, tree)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray):
        size = (1 << DEPTH) - 1
        feature, cut = np.full(size, -1), np.zeros(size, int)
        at = np.zeros(len(x), int)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            gains = np.full((x.shape[1], width, BINS), -np.inf)
            for f in range(x.shape[1]):
                key = (at - first) * BINS + x[:, f]
                gs, hs, ns = (np.bincount(key, w, minlength=width * BINS).reshape(width, BINS) for w in (g, h, np.ones(len(x))))
                gl, hl, nl = gs.cumsum(1), hs.cumsum(1), ns.cumsum(1)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gains[f] = np.where((nl >= LEAF) & (nt - nl >= LEAF), gain, -np.inf)
            for k in range(width):
                f, c = np.unravel_index(np.argmax(gains[:, k]), (x.shape[1], BINS))
                if gains[f, k, c] > 1e-6:
                    feature[first + k], cut[first + k] = f, c
            at = self._step(x, at, feature, cut)
        leaves = np.bincount(at - size, minlength=size + 1), np.bincount(at - size, g, minlength=size + 1), np.bincount(at - size, h, minlength=size + 1)
        return feature, cut, -RATE * leaves[1] / (leaves[2] + 1)

    @staticmethod
    def _step(x: np.ndarray, at: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        f = feature[at]
        return 2 * at + 1 + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]))

    def _leaf(self, x: np.ndarray, tree) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        for _ in range(DEPTH):
            at = self._step(x, at, feature, cut)
        return value[at - len(feature)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return 1 / (1 + np.exp(-(self.start + sum(self._leaf(binned, t) for t in self.trees))))


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on p, by pooling adjacent violators."""
    order = np.argsort(p, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, least p, largest p
    for a, b in zip(p[order], y[order]):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, high = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = high
    xs = np.array([v for q in pools for v in (q[2], q[3])])
    # one row of each kind is added to a pool, so that no score is 0 or 1 for a pool of a few rows
    ys = np.array([(q[0] + y.mean()) / (q[1] + 1) for q in pools for _ in (0, 1)])
    return xs, np.maximum.accumulate(ys)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic"):
    """(lexicon, trees, calibration), or None if the labels don't hold both kinds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1.0, sample / max(1, n))))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    half = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 <= 2, 0).otherwise(1)
    rows = stored(texts.join(F.broadcast(picked), "doc_id").select("text", "y", half.cast("int").alias("half")), "toxic-sample")  # about `sample` ids are sent

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for text, y, h in zip(b.text, b.y, b.half):
                seen.update((t, h, int(y > 0)) for t in {t for w in set(WORD.findall((text or "").lower())) for t in terms(w)})
            yield pd.DataFrame([(t, h, y, c) for (t, h, y), c in seen.items()], columns=["term", "half", "y", "n"])

    sums = [F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)]
    counted = rows.mapInPandas(count, "term string, half int, y int, n long").groupBy("term").agg(*sums)
    often = counted.where(F.col("n01") + F.col("n11") >= LEAST_ROWS).orderBy(F.desc(F.col("n01") + F.col("n11")), "term").limit(ENTRIES).collect()
    size = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", (F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    at = lambda h, y: size.get((h, y), 0)
    if not (at(0, 1) + at(1, 1) and at(0, 0) + at(1, 0)):
        return None
    own = [_lexicon([(r["term"], r[f"n{h}1"], r[f"n{h}0"]) for r in often], at(h, 1), at(h, 0)) for h in (0, 1)]
    whole = _lexicon([(r["term"], r["n01"] + r["n11"], r["n00"] + r["n10"]) for r in often], at(0, 1) + at(1, 1), at(0, 0) + at(1, 0))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [features(t, own[1 - h]) for t, h in zip(b.text, b.half)], "y": (b.y > 0).astype(int), "half": b.half})

    made = rows.mapInPandas(measure, "x array<double>, y int, half int").toPandas()
    x, y, h = np.stack(made.x.to_numpy()), made.y.to_numpy(), made.half.to_numpy()
    order = np.lexsort((*x.T, y, h))
    x, y, h = x[order], y[order].astype(float), h[order]
    apart = np.full(len(y), y.mean())
    for k in (0, 1):
        if 0 < y[h != k].sum() < (h != k).sum() and (h == k).any():
            apart[h == k] = Trees(x[h != k], y[h != k]).predict(x[h == k])
    return whole, Trees(x, y), isotonic(apart, y)


def score(docs: DataFrame, model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted. The model, of bounded size, goes to every task."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if sent.value is None or not len(b):
                value = np.zeros(len(b))
            else:
                lexicon, trees, (xs, ys) = sent.value
                value = np.clip(np.interp(trees.predict(np.array([features(t, lexicon) for t in b.text])), xs, ys), 0, 1)
            yield pd.DataFrame({"doc_id": b.doc_id, "held_out": b.held_out, "score": value, "predicted": (value >= 0.5).astype(np.int32)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(each, "doc_id long, held_out boolean, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that aren't held out, then score all rows."""
    return score(docs, train(docs, labels))
