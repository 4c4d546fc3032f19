"""License scans against counting every token of every block, and against places found by a pattern."""

import random
import re
from collections import Counter

import pytest

from pulsegrid.llm import licenses


def by_hand(text, notices=licenses.NOTICES, contained=licenses.CONTAINED, block=licenses.BLOCK):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    shares = {}
    for at in range(0, max(1, len(words) - block // 2), block // 2):
        own = Counter(words[at : at + block])
        for label, notice in notices.items():
            wanted = Counter(re.findall(r"[a-z0-9]+", notice.lower()))
            share = (own & wanted).total() / wanted.total()
            if share >= contained - 1e-12:
                shares[label] = max(share, shares.get(label, 0))
    base = sorted({label for _, label in places})
    score = 1.0 if places else max(shares.values(), default=0.0)
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    return len(words), len(places), first, last, ",".join(base), ",".join(sorted({*base, *shares})), score


@pytest.fixture(scope="module")
def made():
    """Notices whole, worn to about the threshold, wrapped, cut by block ends; phrases at all places; odd rows."""
    r = random.Random(7)
    filler = ["".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 7))) for _ in range(500)] + "the of and in to this license software a is or".split()
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "CC BY"), (5, "mit license MIT\nLicense, mit-license"), (6, "Apache   License apache license cc by cc by"), (7, "é" * 50_000), (8, "word " * 30_000), (None, "GNU General\nPublic License"), (9, "gnu general public licenses"), (9, "gnu general public licenses")]
    for i in range(150):
        out = []
        for _ in range(r.randint(1, 4)):
            out += [r.choice(filler) for _ in range(r.choice([0, 5, 100, 240, 500, 700]))]
            worn = r.choice(list(licenses.NOTICES.values())).split()
            keep = r.choice([1, 0.95, 0.85, 0.8, 0.75, 0.5])
            out += [w for w in worn if r.random() < keep]
        out += [r.choice(filler) for _ in range(r.choice([0, 300]))] + r.choice([[], ["Apache", "License"]])
        rows.append((100 + i, "".join(w + r.choice([" ", "\n", "\n// "]) for w in out)))
    return rows


def test_scan_equals_counting_by_hand(spark, made):
    df = spark.createDataFrame([(*x, "clash", 1) for x in made], "doc_id bigint, text string, n_words string, notices int")
    found = sorted((tuple(r) for r in licenses.report(licenses.scan(df)).collect()), key=str)
    assert found == sorted(((i, *by_hand(t)) for i, t in made), key=str)
    labels = Counter(x for r in found for x in r[6].split(","))
    assert all(labels[x] > 3 for x in licenses.NOTICES)
    assert licenses.report(licenses.scan(df.limit(0))).count() == 0


def test_filters_lose_nothing_at_any_threshold(made):
    for contained in (0.3, 0.6, 1.0):
        index = licenses.Index(licenses.NOTICES, Counter(w for _, t in made for w in licenses.words_of(t)), contained)
        for _, text in made:
            words = licenses.words_of(text)
            shares = index.found(words)
            hand = by_hand(text, contained=contained)
            assert sorted(shares) == sorted(set(hand[5].split(",")) - {"", *licenses.PHRASES.values()})


def test_unfit_notices_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="words"):
        licenses.scan(df, {"long": "word " * 300})
    with pytest.raises(ValueError, match="characters"):
        licenses.scan(df, {str(i): "word " * 200 for i in range(10_000)})
