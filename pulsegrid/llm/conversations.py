"""Conversation structure repair: the cheapest edits that make roles alternate, by a checkpointed dynamic programme.

A conversation's rows stand in the order of their turns (nulls first). A row is blank (no visible character), else a
duplicate (its role and text stand in an earlier row), else truncated (its last visible character is none of ``.!?``).
The repaired roles are nothing, or an optional system turn and then pairs of user and assistant. Edits and their costs:
keep a row (K, 0), give it the role user or assistant (R, 2), delete it (D, 3; blank and duplicate rows must go), insert
an empty turn (I, 2); a truncated row that stays costs 1 more. Of the cheapest edits those are taken whose initials, in
order, are least in ASCII.

What is still to pay from a place on depends on one of four states only (nothing yet, after system, user, assistant).
Walking backward, such a vector of four costs is kept at every sqrt(n)-th row; walking forward, the vectors between two
kept ones are made again, and at each row the first edit in ASCII order is taken that is tight, that is, after which
what is still to pay is what it should be.

Rows are sorted once, over all partitions, and packed into segments of ``SEGMENT`` rows. A conversation that lies in
one segment is repaired there. In any other one each segment gives a table of its costs from each state to each, the
vectors at its segments' ends are found over one row a segment, and each segment is then walked by itself, first from
all four states to see where they lead, then from its own. So no task holds a long conversation; only its digest reads
its pieces one after the other, as a hash must.

Null texts and roles are one space each, so such a text is blank; such a role, and an empty one, fits nowhere, so its
row is given another or goes. A null conv_id is a conversation of its own. Rows with the same turn follow by role, then
by the first 64 characters of their text, then by its hash, so equal rows stand together. Texts may be of any length.
An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import give_back, stored

SEGMENT = 4096
SEGMENT_CHARS = 1 << 22
KEEP, REROLE, DELETE, INSERT, TRUNCATED_STAYS = 0, 2, 3, 2, 1
NEVER = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The state a turn of that initial leads to, where it may stand.
_KEPT = {(START, SYSTEM): SYSTEM, (START, USER): USER, (SYSTEM, USER): USER, (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER}
#: The state that a turn of a chosen role leads to: after a user's the assistant's, else the user's.
_MADE = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
Vector = tuple[int, int, int, int]
#: What is still to pay behind the last row: a user's turn lacks its answer, a system's turn a whole pair.
END: Vector = (0, 2 * INSERT, INSERT, 0)


def _least(v: Vector) -> tuple[Vector, int]:
    low = min(v)
    return tuple(min(x - low, NEVER) if x < NEVER else NEVER for x in v), low


class _Steps(dict):
    """For a vector behind a row (least 0) and a row's kind: the vector before it (least 0), the least, and from each state the edits and the state they lead to."""

    def __missing__(self, key: tuple[Vector, int]):
        after, kind = key
        initial, fault = kind & 3, kind >> 2
        stays = TRUNCATED_STAYS if fault == TRUNCATED else 0
        options: list[list[tuple[int, str, int]]] = []
        for s in range(4):
            own = [(DELETE + after[s], "D", s)]
            if fault not in (BLANK, DUPLICATE):
                t = _KEPT.get((s, initial))
                own += [(KEEP + stays + after[t], "K", t)] if t is not None else []
                own += [(REROLE + stays + after[_MADE[s]], "R", _MADE[s])]
            options.append(own)
        v = [min(o)[0] for o in options]
        v[USER], v[ASSISTANT] = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
        for s in (START, SYSTEM):
            v[s] = min(v[s], INSERT + v[USER])
        edits = []
        for s in range(4):
            found = ""
            while v[s] < NEVER:
                tight = [(e, t) for cost, e, t in options[s] if cost == v[s]] + [("I", _MADE[s])] * (v[s] == INSERT + v[_MADE[s]])
                e, s = min(tight)
                found += e
                if e != "I":
                    break
            edits.append((found, s))
        out = self[key] = (*_least(tuple(v)), edits)
        return out


_steps = _Steps()


def before(kinds: bytes, v: Vector) -> tuple[Vector, int]:
    """The vector in front of rows of these kinds, as one with least 0 and the least, from the one behind them."""
    v, total = _least(v)
    for k in reversed(kinds):
        v, low, _ = _steps[v, k]
        total += low
    return v, total


def table(kinds: bytes) -> list[int]:
    """The least cost from each state in front of the rows to each behind them, row by row (16 numbers)."""
    columns = []
    for t in range(4):
        v, low = before(kinds, tuple(0 if s == t else NEVER for s in range(4)))
        columns.append([x + low if x < NEVER else NEVER for x in v])
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(kinds: bytes, behind: Vector, state: int) -> tuple[list[str], int]:
    """The edits at each row, insertions in front of it first, and the state behind the rows."""
    n = len(kinds)
    width = isqrt(n) + 1
    starts = list(range(0, n, width))
    marks: list[Vector] = [_least(behind)[0]] * (len(starts) + 1)  # the vectors at checkpoints
    for b in range(len(starts) - 1, -1, -1):
        marks[b] = before(kinds[starts[b] : starts[b] + width], marks[b + 1])[0]
    out = []
    for b, lo in enumerate(starts):
        block = kinds[lo : lo + width]
        vectors = [marks[b + 1]]
        for k in reversed(block[1:]):
            vectors.append(_steps[vectors[-1], k][0])
        for k, v in zip(block, reversed(vectors)):
            edits, state = _steps[v, k][2][state]
            out.append(edits)
    return out, state


def closing(state: int) -> str:
    """The insertions behind the last row."""
    return "I" * (END[state] // INSERT)


def applied(edits: list[str], state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired turns; edits beyond the rows are insertions."""
    new_roles, new_texts = [], []
    for i, es in enumerate(edits):
        for e in es:
            if e == "D":
                continue
            if e == "K":
                state = _KEPT[state, _INITIAL[roles[i][0]]]
                new_roles.append(roles[i])
            else:
                state = _MADE[state]
                new_roles.append(_ROLE[state])
            new_texts.append("" if e == "I" else texts[i])
    return new_roles, new_texts


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults of known places, by crc32 of ``conv_id:turn`` modulo 20; dropped rows stay as ``gone``."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(plain[0], F.lit(":"), plain[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(plain[3], ".!?", "")).otherwise(plain[3])
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(plain[2]).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).drop("_", "times")


#: codes: a byte a row, its role's initial and 4 if it is blank or 8 if it is truncated; keys: 16 bytes a row.
_SEGMENTS = "conv_id bigint, part int, no int, n int, low bigint, high bigint, turns int, codes binary, keys binary, roles array<string>, texts array<string>"


def _code(role: str, text: str) -> int:
    seen = text.rstrip(" \t\n\x0b\x0c\r")
    return _INITIAL.get(role[:1], 0) + (0 if seen and seen[-1] in ".!?" else 8 if seen else 4)


def segments(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) sorted and packed; a segment's place is (part, no). Stored."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chars, no, turns, roles, texts, begun = None, 0, 0, [], [], [], False
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def packed() -> pa.RecordBatch:
            known = [t for t in turns if t is not None]
            keys = b"".join(hashlib.md5(f"{len(r)}:{r}{t}".encode("utf-8", "replace")).digest() for r, t in zip(roles, texts))
            row = [conv, part, no, len(roles), known[0] if known else None, known[-1] if known else None, len(set(known)), bytes(map(_code, roles, texts)), keys, roles, texts]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [c.split()[0] for c in _SEGMENTS.split(", ")])

        for b in batches:
            for c, turn, role, text, gone in zip(*(b.column(i) for i in range(5))):
                c = c.as_py()
                if not begun or c != conv or len(roles) >= SEGMENT or chars >= SEGMENT_CHARS:
                    if begun:
                        yield packed()
                        no += 1
                    conv, chars, turns, roles, texts, begun = c, 0, [], [], [], True
                if not gone.as_py():  # a conversation all of whose rows are gone is a segment without rows
                    turns.append(turn.as_py())
                    roles.append(role.as_py())
                    texts.append(text.as_py())
                    chars += len(texts[-1])
        if begun:
            yield packed()
        give_back()

    start, h = F.substring("text", 1, 64), F.xxhash64("text")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), start, h]
    # equal rows may lie in any order, so a number may deal them to several partitions
    sorted_rows = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    return stored(sorted_rows.select("conv_id", "turn", "role", "text", "gone").mapInArrow(each, _SEGMENTS), "segments")


def kinds_of(codes: bytes, keys: bytes, earlier: set[bytes] = frozenset()) -> bytes:
    """A byte a row: its role's initial and 4 times its first fault; ``earlier``: keys of rows of earlier segments."""
    seen, out = set(earlier), bytearray()
    for i, c in enumerate(codes):
        key = keys[16 * i : 16 * i + 16]
        out.append((c & 3) + 4 * (BLANK if c & 4 else DUPLICATE if key in seen else TRUNCATED if c & 8 else FINE))
        seen.add(key)
    return bytes(out)


def counts(kinds: bytes) -> list[int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials don't follow each other."""
    faults = [k >> 2 for k in kinds]
    return [faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), sum((a & 3, b & 3) not in _LEGAL for a, b in zip(kinds, kinds[1:]))]


TOTALS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
PIECES = f"conv_id bigint, part int, no int, alone boolean, {TOTALS}, audit string, roles array<string>, texts array<string>"
_PLACE = ["conv_id", "part", "no"]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Objects, so that whole numbers beside nulls stay whole."""
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def _id(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _alone(segs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                kinds = kinds_of(r.codes, r.keys)
                edits, state = walk(kinds, END, START)
                edits.append(closing(state))
                v, low = before(kinds, END)
                roles, texts = applied(edits, START, r.roles, r.texts)
                gaps = 0 if pd.isna(r.low) else int(r.high) - int(r.low) + 1 - r.turns
                out.append((_id(r.conv_id), r.part, r.no, True, gaps, *counts(kinds), v[START] + low, "".join(edits), roles, texts))
            yield _frame(out, PIECES)
        give_back()

    # whole numbers near 2**53 would lose digits as doubles, which is what pandas makes of columns with nulls
    exact = segs.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "low", "high")})
    return exact.mapInPandas(each, PIECES)


def _marked(segs: DataFrame) -> DataFrame:
    """kinds, counts and table of costs of segments whose conversation has others, with what stands in earlier ones. Stored."""

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, keys in enumerate(b.column("keys")):
                keys = keys.as_py()
                own = list({keys[k : k + 16] for k in range(0, len(keys), 16)})
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(pa.array(row.column(c).to_pylist() * len(own), row.column(c).type) for c in _PLACE), pa.array(own, pa.binary())], [*_PLACE, "key"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                kinds = kinds_of(r.codes, r.keys, set() if r.earlier is None else set(r.earlier))
                out.append((_id(r.conv_id), r.part, r.no, r.n, _id(r.low), _id(r.high), r.turns, kinds, counts(kinds), table(kinds)))
            yield _frame(out, schema)

    schema = "conv_id bigint, part int, no int, n int, low bigint, high bigint, turns int, kinds binary, counts array<bigint>, table array<bigint>"
    keys = segs.select(*_PLACE, "keys").mapInArrow(own_keys, "conv_id bigint, part int, no int, key binary")
    first = F.min(F.struct("part", "no")).over(Window.partitionBy("conv_id", "key"))  # a row a segment at most
    earlier = keys.withColumn("first", first).where(F.struct("part", "no") > F.col("first")).groupBy(*_PLACE).agg(F.collect_list("key").alias("earlier"))
    exact = _joined(segs.drop("roles", "texts"), earlier, "left").withColumns({c: F.col(c).cast("string") for c in ("conv_id", "low", "high")})
    return stored(exact.mapInPandas(each, schema), "marked-segments")


def _joined(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """On (conv_id, part, no), of which the two last are enough: a place has one segment."""
    return a.join(b.drop("conv_id"), ["part", "no"], how)


def _behind(marked: DataFrame) -> DataFrame:
    """The vector behind each segment and its conversation's totals, over one row a segment. Stored."""

    def each(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["part", "no"])
        v, behind = END, []
        for t in reversed(b["table"].tolist()):
            behind.append(list(v))
            v = tuple(min(NEVER, *(t[4 * s + k] + v[k] for k in range(4))) for s in range(4))
        turns, illegal, lows, highs, kind = 0, 0, [], [], None
        for r in b[b.n > 0].itertuples(index=False):
            illegal += kind is not None and (kind & 3, r.edge[0] & 3) not in _LEGAL
            kind = r.edge[1]
            if r.low is not None:
                turns += r.turns - (highs[-1:] == [int(r.low)])  # a turn may go on across segments
                lows.append(int(r.low))
                highs.append(int(r.high))
        gaps = highs[-1] - lows[0] + 1 - turns if lows else 0
        sums = [sum(x) for x in zip(*b["counts"].tolist())]
        sums[3] += illegal
        out = [(_id(key[0]), p, o, x, gaps, *sums, v[START]) for p, o, x in zip(b.part, b.no, reversed(behind))]
        return _frame(out, schema)

    schema = f"conv_id bigint, part int, no int, behind array<bigint>, {TOTALS}"
    edge = F.when(F.col("n") > 0, F.concat(F.expr("substring(kinds, 1, 1)"), F.expr("substring(kinds, -1, 1)"))).alias("edge")
    small = marked.select(F.col("conv_id").cast("string").alias("conv_id"), "part", "no", "n", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"), "turns", "counts", "table", edge)
    return stored(small.groupBy("conv_id").applyInPandas(each, schema), "behind-segments")


def _entries(marked: DataFrame, behind: DataFrame) -> DataFrame:
    """The state in front of each segment and whether it is the last: where each state leads, then one row a segment. Stored."""

    def leads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [[walk(k, tuple(map(int, v)), s)[1] for s in range(4)] for k, v in zip(b.kinds, b.behind)]
            yield pd.DataFrame({"conv_id": b.conv_id, "part": b.part, "no": b.no, "leads": ends})

    def each(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b, state, entries = b.sort_values(["part", "no"]), START, []
        for to in b.leads:
            entries.append(state)
            state = int(to[state])
        return pd.DataFrame({"part": b.part, "no": b.no, "entry": entries, "last": [False] * (len(b) - 1) + [True]})

    to = _joined(marked.select(F.col("conv_id").cast("string").alias("conv_id"), "part", "no", "kinds"), behind.select(*_PLACE, "behind")).mapInPandas(leads, "conv_id string, part int, no int, leads array<int>")
    return stored(to.groupBy("conv_id").applyInPandas(each, "part int, no int, entry int, last boolean"), "entries")


def _among(segs: DataFrame) -> DataFrame:
    """The pieces of conversations of several segments."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                edits, state = walk(r.kinds, tuple(map(int, r.behind)), r.entry)
                edits.append(closing(state) if r.last else "")
                roles, texts = applied(edits, r.entry, r.roles, r.texts)
                out.append((_id(r.conv_id), r.part, r.no, False, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, "".join(edits), roles, texts))
            yield _frame(out, PIECES)
        give_back()

    marked = _marked(segs)
    behind = _behind(marked)
    full = _joined(_joined(_joined(segs.select(*_PLACE, "roles", "texts"), marked.select(*_PLACE, "kinds")), behind), _entries(marked, behind))
    return full.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(each, PIECES)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired turns of rows (conv_id, turn, role, text, gone), a row for each segment of a conversation.

    Such a piece has its place (part, no) among its conversation's, whether it is ``alone``, the conversation's counts
    of faults and its cost, and of its own stretch the initials of the edits and the roles and texts that they leave.
    """
    segs = segments(rows)
    several = stored(segs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv")), "several")
    alone = segs.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti")
    found = _alone(alone)
    if several.head(1):
        among = segs.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
        found = found.union(_among(among))
    return stored(found, "repaired")


def turns(pieces: DataFrame) -> DataFrame:
    """The repaired turns one by one: conv_id, their place (part, no, at), role and text."""
    return pieces.select(*_PLACE, F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "x")).select(*_PLACE, "at", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


DIGESTS = f"conv_id bigint, {TOTALS}, audit string, repaired_sha256 string"


def digests(pieces: DataFrame) -> DataFrame:
    """A row per conversation: counts of faults, cost, all edits, and the sha256 of its turns as ``role:text`` lines."""
    names = [c.split()[0] for c in TOTALS.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        at, first, audit, sha, empty = None, None, [], None, True

        def done() -> pa.RecordBatch:
            row = [*first, "".join(audit), sha.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row[:-2]] + [pa.array([x], pa.string()) for x in row[-2:]], [c.split()[0] for c in DIGESTS.split(", ")])

        for b in batches:
            for i in range(len(b)):
                r = b.slice(i, 1).to_pylist()[0]
                if sha is None or r["conv_id"] != at:
                    if sha is not None:
                        yield done()
                    at, first, audit, sha, empty = r["conv_id"], [r["conv_id"], *(r[c] for c in names)], [], hashlib.sha256(), True
                audit.append(r["audit"])
                for role, text in zip(r["roles"], r["texts"]):
                    sha.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
                    empty = False
        if sha is not None:
            yield done()

    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    alone = pieces.where("alone").select("conv_id", *names, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    # a hash takes its bytes in order: the pieces of a conversation pass one task, which holds one at a time
    order = [F.col("conv_id").asc_nulls_first(), F.col("part"), F.col("no")]
    rest = pieces.where("not alone").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(each, DIGESTS)
    return alone.union(rest)
