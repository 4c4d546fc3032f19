"""Conversation repair against a search over whole sequences of edits, however the rows are cut into segments."""

import hashlib
import random
import re
import zlib

import pytest

from pulsegrid.llm import conversations

FOLLOWS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def by_hand(rows):
    """Counts of faults, neighbours that don't follow, cost, edits and digest of (role, text) rows."""
    seen, faults = set(), [0, 0, 0]

    def inserted(best):
        for _ in range(3):
            for s, (cost, edits, out) in list(best.items()):
                new = (cost + 2, edits + "I", (*out, f"{NAME[NEXT[s]]}:"))
                if NEXT[s] not in best or new[:2] < best[NEXT[s]][:2]:
                    best[NEXT[s]] = new
        return best

    best = inserted({"": (0, "", ())})
    for role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 1 if not visible else 2 if (role, text) in seen else 3 if visible[-1] not in ".!?" else 0
        faults = [n + (fault == k + 1) for k, n in enumerate(faults)]
        seen.add((role, text))
        new = {}
        for s, (cost, edits, out) in best.items():
            options = [(s, (cost + 3, edits + "D", out))]
            if fault not in (1, 2):
                more = int(fault == 3)
                if role[:1] in FOLLOWS[s]:
                    options.append((FOLLOWS[s][role[:1]], (cost + more, edits + "K", (*out, f"{role}:{text}"))))
                options.append((NEXT[s], (cost + more + 2, edits + "R", (*out, f"{NAME[NEXT[s]]}:{text}"))))
            for t, o in options:
                if t not in new or o[:2] < new[t][:2]:
                    new[t] = o
        best = inserted(new)
    cost, edits, out = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    return (*faults, illegal, cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest())


def all_by_hand(table):
    found = {}
    for conv, turn, role, text in table:
        rows = found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64]))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *by_hand([r[1:] for r in rows]))
    return out


@pytest.fixture(scope="module")
def made():
    """Nulls everywhere, ties of turns, repeated and blank rows, odd roles, large numbers, a long text, a gone conversation."""
    r = random.Random(3)
    rows = []
    for i in range(120):
        for k in range(r.randint(0, 14)):
            role = r.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant", "user", "assistant"])
            rows.append((1000 + i if i else None, r.choice([None, k, k, k, k - 1, 2**60 + k]), role, r.choice([None, "", "  \n", "Hi.", "Hi", "Yes!", "ok?", "long one here", "x .\t", "no. ü"])))
    rows += [(1, 0, "user", "word " * 200_000), (1, 1, "assistant", "end.")]
    gone = next(i for i in range(2000, 3000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "Hello.")]


@pytest.mark.parametrize("segment", [4096, 5, 1])
def test_repair_equals_search_by_hand(spark, made, segment, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    df = spark.createDataFrame([(*x, "clash", 1) for x in made], "conv_id bigint, turn bigint, role string, text string, kinds string, part int")
    pieces = conversations.repair(conversations.damaged(df))
    found = conversations.digests(pieces).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == all_by_hand(made) and len(found) == len({x[0] for x in made})
    roles = {}
    for t in sorted(conversations.turns(pieces).collect(), key=lambda t: (t.part, t.no, t.at)):
        roles[t.conv_id] = roles.get(t.conv_id, "") + t.role[0]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values()) and len(roles) > 90


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.digests(conversations.repair(conversations.damaged(df))).count() == 0


def test_a_long_conversation_costs_what_its_checkpoints_say():
    """Rows repaired whole or in stretches: the same edits and costs."""
    r = random.Random(1)
    kinds = bytes(r.choice([1, 2, 3, 2, 3, 2, 3, 0, 4, 8, 14, 15]) for _ in range(20_000))
    edits, state = conversations.walk(kinds, conversations.END, conversations.START)
    v, low = conversations.before(kinds, conversations.END)
    text = "".join(edits) + conversations.closing(state)
    cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in text) + sum(k >> 2 == conversations.TRUNCATED and "D" not in e for k, e in zip(kinds, edits))
    assert v[conversations.START] + low == cost and len(text) - text.count("I") == len(kinds)
