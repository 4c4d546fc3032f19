"""Personal data: four exact kinds, and spans that a character-level bidirectional LSTM with CRF transitions adds.

The base finds email, ip, card and phone from their patterns. The model tags characters (outside, or begin / inside of
each kind, ``secret`` for keys and passwords among them). It is trained in numpy from labelled spans: windows of a
bounded sample of documents (around their base and secret spans, and elsewhere), and sentences that are put together
from parts, with forms that the patterns miss (phones without a plus sign, spelled-out addresses) and look-alikes that
aren't data (dates, prices, times, versions, bare numbers).

The whole text is cut into windows of ``WINDOW`` characters that overlap by twice ``MARGIN``, and every window is
scored. Those in which some character is sure enough to be part of a span are decoded, those beside them, and those that
a run of tags goes on into. A character takes its tag from the window that has it in its middle, and runs of tags go on
across windows, so spans may have any length. What is proposed is taken to the ends of the words or numbers that it is
in, and dropped where its form says that it is something else (compounds, paths, names of keys, UUIDs, commits, ISBNs).
What a document's windows propose is reconciled globally: of all proposals that don't touch a base span, those without
overlap of the largest total score are taken. Positions are code points, ends exclusive.

Null texts count as empty and give no spans. Texts of any length are searched whole, in time linear in their length.
Repeated rows are searched one by one; other columns aren't looked at, whatever their names; an empty table gives an
empty result, and a model of made sentences alone.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import by_chars, give_back, stored

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

#: The contract's patterns; a digit before a run of digits can't start a match, as the run itself would have.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"(?i)\b(?:token|password|passwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+-]{16,128})[\"']?|\b(AKIA[0-9A-Z]{16})\b")
DIGIT = re.compile("[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    out = []
    at = text.find("@")
    last = 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append(("email", start, last))
            at = text.find("@", last)
        else:
            # no match can hold this at sign, nor reach over it
            last = at + 1
            at = text.find("@", at + 1)
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# --- the model -----------------------------------------------------------------------------------------------------

#: Characters of a window, and how many at each side are left to its neighbours.
WINDOW, MARGIN = 320, 24
EMBED, HIDDEN = 6, 8
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Sentences put together; documents looked through; windows of these with spans and without that are learnt from.
MADE, SCANNED, HITS, OTHERS = 1200, 20_000, 900, 1500
#: Characters of a window in training; passes, windows of a step, rate of learning.
LESSON, EPOCHS, BATCH, RATE = 96, 12, 64, 0.03
ALONE = 0.5
#: A proposed span must be as sure as this: the mean, over its characters, of the margin over outside.
LEAST_MARGIN = 1.5
NO = -1e4

CHARS = 131
PAD = 130
_CODE = np.full(65536, 128, np.uint8)
_CODE[:128] = np.arange(128)
for _c in range(65536):
    if _c >= 128 and chr(_c).isalpha():
        _CODE[_c] = 129
_CODE[ord("0") : ord("9") + 1] = ord("0")


def coded(text: str) -> np.ndarray:
    """A sign for the text's start, then a code per character: ASCII itself (digits alike), other letters, the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[np.uint8(PAD)], _CODE[np.minimum(points, 65535)]])


def allowed() -> np.ndarray:
    """Transitions that are no error: inside only after begin or inside of the same kind."""
    ok = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = NO
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = 0
    return ok


class Tagger:
    """Embedding, one LSTM each way, a linear layer, and transitions between tags.

    Gates squash by x / (1 + abs(x)), which is plain array arithmetic. Arrays are laid out (way, unit, window); of the
    two ways the second reads from the end.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        make = lambda *s: rng.normal(0, 1 / np.sqrt(s[-1]), s).astype(np.float32)
        gates = make(2, 4 * HIDDEN, HIDDEN + EMBED + 1)  # from the state, the character, and one
        gates[:, :, -1] = 0
        gates[:, HIDDEN : 2 * HIDDEN, -1] = 1
        self.w = {"embed": make(CHARS, EMBED), "gates": gates, "out": make(TAGS, 2 * HIDDEN), "bias": np.zeros((TAGS, 1), np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}

    def _run(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, both ways' units, windows) of codes (time, windows)."""
        gates = self.w["gates"]
        steps, n = codes.shape
        chars = np.ascontiguousarray(self.w["embed"].T[:, codes].swapaxes(0, 1))  # (time, embedding, windows)
        x = np.ones((2, HIDDEN + EMBED + 1, n), gates.dtype)
        x[:, :HIDDEN] = 0
        c = np.zeros((2, HIDDEN, n), gates.dtype)
        z, d, tc = np.empty((2, 4 * HIDDEN, n), gates.dtype), np.empty((2, 4 * HIDDEN, n), gates.dtype), np.empty_like(c)
        states = np.empty((steps, 2, HIDDEN, n), gates.dtype)
        for t in range(steps):
            x[0, HIDDEN:-1], x[1, HIDDEN:-1] = chars[t], chars[steps - 1 - t]
            np.matmul(gates, x, out=z)
            np.abs(z, out=d)
            d += 1
            z /= d
            if keep is not None:
                keep.append((x.copy(), z.copy(), c.copy()))
            z[:, : 3 * HIDDEN] += 1
            z[:, 3 * HIDDEN :] *= z[:, :HIDDEN]
            c *= z[:, HIDDEN : 2 * HIDDEN]
            c += z[:, 3 * HIDDEN :]
            c *= 0.5
            np.abs(c, out=tc)
            tc += 1
            np.divide(c, tc, out=tc)
            tc *= z[:, 2 * HIDDEN : 3 * HIDDEN]
            tc *= 0.5
            x[:, :HIDDEN] = tc
            states[t, 0], states[steps - 1 - t, 1] = tc
        return states.reshape(steps, 2 * HIDDEN, n)

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(time, tags, windows)."""
        return np.matmul(self.w["out"], self._run(codes)) + self.w["bias"]

    def loss_gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean loss of a batch and its gradients; both inputs (time, windows).

        To the CRF's loss comes ``ALONE`` times the loss of each character's scores by themselves, so that these are
        low where there is no span, whatever the transitions.
        """
        w, (steps, n) = self.w, codes.shape
        kept: list = []
        both = self._run(codes, kept)
        e = np.moveaxis(np.matmul(w["out"], both) + w["bias"], 1, 2)  # (time, windows, tags)
        move = w["move"] + allowed()
        first = np.zeros(TAGS, e.dtype)
        first[2::2] = NO
        ways, top = np.exp(move), e.max(axis=2, keepdims=True)
        weight = np.exp(e - top)
        # forward and backward sums, scaled to one at each step
        a, b, c = np.empty_like(e), np.ones_like(e), np.empty((steps, n, 1), e.dtype)
        for t in range(steps):
            a[t] = weight[t] * (a[t - 1] @ ways if t else np.exp(first))
            c[t] = a[t].sum(axis=1, keepdims=True)
            a[t] /= c[t]
        for t in range(steps - 2, -1, -1):
            b[t] = (weight[t + 1] * b[t + 1] / c[t + 1]) @ ways.T
        z = (np.log(c) + top).sum(axis=(0, 2))
        de = a * b
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["move"] = ways * (a[:-1].reshape(-1, TAGS).T @ (weight[1:] * b[1:] / c[1:]).reshape(-1, TAGS))
        np.subtract.at(grad["move"], (tags[:-1], tags[1:]), 1)
        grad["move"] /= n
        at = np.arange(n)
        each = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0]
        gold = first[tags[0]] + each.sum(axis=0) + move[tags[:-1], tags[1:]].sum(axis=0)
        de[np.arange(steps)[:, None], at[None, :], tags] -= 1
        alone = weight / weight.sum(axis=2, keepdims=True)
        gold = gold + ALONE * np.log(np.take_along_axis(alone, tags[:, :, None], 2)[:, :, 0] + 1e-30).sum(axis=0)
        alone[np.arange(steps)[:, None], at[None, :], tags] -= 1
        de += ALONE * alone
        de = np.ascontiguousarray(np.moveaxis(de, 1, 2)) / n  # (time, tags, windows)
        grad["bias"] = de.sum(axis=(0, 2))[:, None]
        grad["out"] = np.einsum("tkn,thn->kh", de, both, optimize=True)
        dh_all = np.matmul(w["out"].T, de).reshape(steps, 2, HIDDEN, n)
        dh, dc = np.zeros((2, HIDDEN, n), e.dtype), np.zeros((2, HIDDEN, n), e.dtype)
        d_chars = np.zeros((steps, EMBED, n), e.dtype)
        for t in range(steps - 1, -1, -1):
            x, u, c0 = kept[t]
            i, f, o, g = (u[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            i, f, o = 0.5 + 0.5 * i, 0.5 + 0.5 * f, 0.5 + 0.5 * o
            c = f * c0 + i * g
            tc = c / (1 + np.abs(c))
            dh[0] += dh_all[t, 0]
            dh[1] += dh_all[steps - 1 - t, 1]
            dc += dh * o * (1 - np.abs(tc)) ** 2
            dz = np.concatenate([dc * g * 0.5, dc * c0 * 0.5, dh * tc * 0.5, dc * i], axis=1) * (1 - np.abs(u)) ** 2
            grad["gates"] += np.matmul(dz, x.swapaxes(1, 2))
            dx = np.matmul(w["gates"].swapaxes(1, 2), dz)
            dh, dc = dx[:, :HIDDEN].copy(), dc * f
            d_chars[t] += dx[0, HIDDEN:-1]
            d_chars[steps - 1 - t] += dx[1, HIDDEN:-1]
        grad["embed"] = np.stack([np.bincount(codes.ravel(), d_chars[:, k].ravel(), CHARS) for k in range(EMBED)], axis=1).astype(e.dtype)
        return float((z - gold).mean()), grad

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Tagger:
        """Adam over shuffled batches; codes and tags are (windows, time). The weights are the mean of those of the last quarter of steps."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        total, step = epochs * -(-len(codes) // BATCH), 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                _, grad = self.loss_gradients(codes[rows].T, tags[rows].T)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                step += 1
                rate = RATE * min(1.0, 0.1 + 1.5 * (1 - step / (total + 1)))
                for name, g in grad.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v2[name] = 0.99 * v2[name] + 0.01 * g**2
                    self.w[name] = (self.w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                    if step > total - total // 4:
                        mean[name] += self.w[name] / (total // 4)
        if total >= 4:
            self.w = mean
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags (time, windows) for emissions (time, tags, windows)."""
        move = self.w["move"]
        to = np.array([0, *range(1, TAGS, 2)])  # these may follow any tag; an inside only its own begin and inside
        inside = np.arange(2, TAGS, 2)
        free, begun, going = np.ascontiguousarray(move[:, to].T)[:, :, None], move[inside - 1, inside][:, None], move[inside, inside][:, None]
        best = e[0].copy()
        best[inside] += NO
        back = np.empty(e.shape, np.uint8)
        for t in range(1, len(e)):
            total = free + best  # (to, from, windows)
            back[t, to] = total.argmax(axis=1)
            a, b = best[inside - 1] + begun, best[inside] + going
            back[t, inside] = np.where(a >= b, inside[:, None] - 1, inside[:, None])
            best = np.empty_like(best)
            best[to], best[inside] = total.max(axis=1), np.maximum(a, b)
            best += e[t]
        tags = np.zeros((len(e), e.shape[2]), np.uint8)
        at = np.arange(e.shape[2])
        tags[-1] = best.argmax(axis=0)
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t], at]
        return tags

    def decode(self, codes: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows (time, windows), those that can take part in a proposal; their tags, and each character's margin over outside.

        A proposal's mean margin is at least ``LEAST_MARGIN``, so one of its characters has that margin for some tag.
        Windows without such a character are left out, but for those beside one with, and, from these on, those into
        which a run of tags goes on; ``joins`` tells whether a window goes on with the text of the one before it.
        """
        e = self.emissions(codes)
        e -= e[:, :1]
        own = e[:, 1:].max(axis=(0, 1)) >= LEAST_MARGIN
        beside = lambda from_left, from_right: (np.concatenate([[False], from_left[:-1]]) & joins) | np.concatenate([(from_right & joins)[1:], [False]])
        new = own | beside(own, own)
        live, tags = new.copy(), np.zeros((len(e), e.shape[2]), np.uint8)
        while new.any():
            at = np.flatnonzero(new)
            tags[:, at] = self.viterbi(np.ascontiguousarray(e[:, :, at]))
            new = beside(new & (tags[-1] > 0), new & (tags[0] > 0)) & ~live
            live |= new
        live = np.flatnonzero(live)
        tags = np.ascontiguousarray(tags[:, live])
        return live, tags, np.take_along_axis(np.ascontiguousarray(e[:, :, live]), tags[:, None], 1)[:, 0]


# --- labelled spans ------------------------------------------------------------------------------------------------


def made(n: int, seed: int = 5, kinds: tuple[str, ...] = KINDS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences put together from parts: texts with their labelled spans."""
    r = random.Random(seed)
    syllable = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la ch der die und que des ión br cor ry bo sta mp".split()
    word = lambda: "".join(r.choice(syllable) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: word() + r.choice(["", "", digits(1), digits(2), "." + word(), "_" + word()])
    of = lambda alphabet, low, high: "".join(r.choice(alphabet) for _ in range(r.randint(low, high)))
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    end = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "io", "edu"])

    def card() -> str:
        body = digits(15)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice([number, " ".join(number[i : i + 4] for i in range(0, 16, 4)), "-".join(number[i : i + 4] for i in range(0, 16, 4))])

    def email() -> str:
        a, b = r.choice([(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" AT ", " DOT "), ("(at)", "(dot)")]) if r.random() < 0.7 else ("@", ".")
        return f"{name()}{a}{word()}{r.choice(['', '', digits(1), b + word()])}{b}{end()}"

    def secret() -> str:
        kind = r.randrange(8)
        if kind == 0:
            return "AKIA" + of(large + "234567", 16, 16)
        if kind == 1:
            return of("0123456789abcdef", 16, 40)
        if kind == 2:
            return of("0123456789abcdef", 40, 128)
        if kind == 3:
            return of(large + small + "0123456789", 16, 44)
        if kind == 4:
            return of(large + small + "0123456789_-+/", 40, 128)
        long = "".join(word() for _ in range(12))
        return long[: r.randint(16, 40)] if r.random() < 0.5 else of(small + large + "_-", 16, 40)

    makers = {
        "email": email,
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+1 ({digits(3)}) 555-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}"]),
        "secret": secret,
    }
    keys = ['token = "', "token: ", "password: ", "password is ", "api_key=", "api-key: ", "secret = '", 'TOKEN = "', "SECRET=", "passwd: ", 'secret: "']
    plain = [
        lambda: digits(r.randint(1, 14)), lambda: f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)}", lambda: f"${digits(2)}.{digits(2)}", lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}",
        lambda: f"{digits(2)}%", lambda: f"no. {digits(3)}", lambda: f"@{word()}", lambda: f"{digits(1)}.{digits(3)}.{digits(3)}", lambda: f"{word()}{digits(2)}", lambda: f"{word()} at {word()}", lambda: f"the dot {word()}", lambda: f"at {word()} dot",
        lambda: f"password: {word()} {word()}", lambda: f"the token {word()}", lambda: f"{word()}{word()}{word()}{word()}", lambda: f"{word().upper()} {word().upper()}", lambda: f"{word()}*** {word()}### {word()}%%%", lambda: f"https://{word()}.{end()}/{word()}-{word()}", lambda: f"{digits(2)} - {digits(2)}", lambda: " ".join((word() + word()).upper() + r.choice(["!!", "", "!", "***", "###"]) for _ in range(r.randint(2, 6))), lambda: f"({word()}) [{word()}]",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(2, 4)):
            text += " ".join(word() for _ in range(r.randint(1, 6))).capitalize() + r.choice([" ", ", ", ". ", ".\n", " "])
            kind = r.choice([*kinds, "plain", "plain"])
            value = r.choice(plain)() if kind == "plain" else makers[kind]()
            if kind == "secret" and not value.startswith("AKIA"):
                text += r.choice(keys)
                if r.random() < 0.1:
                    value = value.upper()
            if kind != "plain":
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + r.choice([" ", ". ", ", ", "### ", "\n", '" ', "' ", "; "])
        out.append((text + word(), spans))
    return out


def labelled_spans(text: str) -> list[tuple[str, int, int]]:
    """What a document's windows are labelled with: base spans, and secrets by their key words."""
    return base_spans(text) + [("secret", *m.span(m.lastindex)) for m in SECRET.finditer(text)]


def lesson(codes: np.ndarray, spans: list[tuple[str, int, int]], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of the training window from ``start`` on; it may begin or end within a span."""
    tags = np.zeros(LESSON, np.uint8)
    for kind, s, e in sorted(spans, key=lambda x: x[1] - x[2]):
        s, e, k = max(s + 1 - start, 0), min(e + 1 - start, LESSON), 1 + 2 * KINDS.index(kind)
        if s < e and not tags[s:e].any():
            tags[s:e] = k + 1
            tags[s] = k
    c = codes[start : start + LESSON]
    return np.pad(c, (0, LESSON - len(c)), constant_values=PAD), tags


def lessons(text: str, spans: list[tuple[str, int, int]], r: random.Random) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Training windows of a text: one about each of its first four spans, one anywhere else; and whether it has a span."""
    codes = coded(text)
    places = [r.randint(max(0, s - LESSON + 8), max(0, e - 8)) for _, s, e in spans[:4]] + [r.randint(0, max(0, len(codes) - LESSON))]
    for at in places:
        c, t = lesson(codes, spans, max(0, min(at, len(codes) - LESSON)))
        yield bool(t.any()), c, t


def train(docs: DataFrame, hits: int = HITS, others: int = OTHERS, text_col: str = "text", id_col: str = "doc_id") -> Tagger:
    """Fit on made sentences and on windows of a sample of documents.

    About ``SCANNED`` documents, picked by a hash of the id, are looked through on Spark; the driver gets ``hits``
    windows with spans and ``others`` without, ``LESSON`` characters each, whatever the table's size.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    share = min(1.0, SCANNED / max(1, rows.count()))
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_003))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(p, hit, c.tobytes(), t.tobytes()) for p, text in zip(b.place, b.text) for hit, c, t in lessons(text, labelled_spans(text), random.Random(int(p)))]
            yield pd.DataFrame(found, columns=["place", "hit", "codes", "tags"])

    picked = rows.withColumn("place", place).where((F.col("place") <= int(1_000_003 * share)) & (F.length("text") > 0)).select("place", "text")
    windows = picked.mapInPandas(each, "place long, hit boolean, codes binary, tags binary")
    ranked = stored(windows.withColumn("order", F.xxhash64("place", "codes")), "lessons")
    some = [r for hit, n in ((True, hits), (False, others)) for r in ranked.where(F.col("hit") == hit).orderBy("order", "codes", "tags").limit(n).collect()]
    r = random.Random(3)
    examples = [x[1:] for t, s in [*made(MADE), *made(MADE // 2, 6, ("email", "phone", "secret", "secret"))] for x in lessons(t, s, r)]
    examples += [(np.frombuffer(x["codes"], np.uint8), np.frombuffer(x["tags"], np.uint8)) for x in some]
    return Tagger().fit(np.stack([c for c, _ in examples]), np.stack([t for _, t in examples]).astype(np.int64))


# --- search --------------------------------------------------------------------------------------------------------


def proposals(tags: np.ndarray, margin: np.ndarray) -> Iterator[tuple[tuple[str, int, int], float]]:
    """Spans that the tags of a text and of the sign before it propose, with their scores."""
    inside = np.flatnonzero(tags)
    at = 0
    while at < len(inside):
        start = int(inside[at])
        within = tags[start] + tags[start] % 2  # the tag for inside of the same kind
        end = start + 1
        while end < len(tags) and tags[end] == within:
            end += 1
        score = float(margin[start:end].sum())
        if score >= LEAST_MARGIN * (end - start):
            yield (KINDS[(int(within) - 1) // 2], max(0, start - 1), end - 1), score
        at = int(np.searchsorted(inside, end))


#: Words that a key or password without a digit stands behind; and those behind which a number or hash is another thing. Fixed values.
KEY_WORD = re.compile(r"(?i)(?:token|passw(?:or[dt]|d)|secret|api[ _-]?key|kennwort|mot de passe|contraseña|clave|schlüssel)[\"']?(?:\s{0,3}[=:]|\s+(?:is|ist|es|est))\s{0,3}[\"']?$")
OTHER_WORD = re.compile(r"(?i)(?:\b(?:commit|revision|rev|sha-?1|sha-?256|md5|digest|checksum|etag)\b[\s:=#]{0,3}|\bisbn(?:-1[03])?\b[\s:]{0,3})$")
UUID = re.compile(r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b")
ISBN = re.compile(r"97[89][- ]?(?:[0-9][- ]?){9}[0-9]")
SPELLED_DOT = re.compile(r"(?i)(?:\s*[(\[]\s*dot\s*[)\]]\s*|\s+dot\s+)[a-z0-9-]+")
DOT_HEAD = re.compile(r"(?i)[(\[]dot[)\]]|dot\s")
DOT_END, DOT_START = re.compile(r"(?i)[(\[]dot[)\]]$|\sdot$"), re.compile(r"(?i)[a-z0-9._%+-]+(?:\s*[(\[]\s*dot\s*[)\]]\s*|\s+dot\s+)$")


def whole(text: str, kind: str, start: int, end: int) -> tuple[int, int]:
    """A span up to the ends of the word, number or spelled-out address that it begins and ends in."""
    part = {"phone": lambda c: c in "0123456789.-", "card": lambda c: c in "0123456789-", "ip": lambda c: c in "0123456789."}.get(kind, lambda c: c.isalnum() or c in "_/+-" * (kind == "secret") + "._%+-" * (kind == "email"))
    first, last = start, end
    while start > 0 and last - start < 4096 and part(text[start - 1]):
        start -= 1
    while end < len(text) and end - first < 4096 and part(text[end]):
        end += 1
    # marks that belong to the sentence
    while start < first and text[start] in ".-/+_":
        start += 1
    while end > last and text[end - 1] in ".-/+_":
        end -= 1
    if kind == "email" and "@" not in text[start:end]:
        if DOT_END.search(text[start:end]) and (m := re.compile(r"\s*[A-Za-z0-9-]+").match(text, end)):
            end = m.end()
        if DOT_HEAD.match(text, start) and (m := re.compile(r"[A-Za-z0-9._%+-]+\s*$").search(text, max(0, start - 64), start)):
            start = m.start()
        while (m := SPELLED_DOT.match(text, end)) and m.end() - start < 256:
            end = m.end()
        while (m := DOT_START.search(text, max(0, start - 64), start)) and end - m.start() < 256:
            start = m.start()
    return start, end


def plausible(kind: str, value: str, before: str = "", around: str = "") -> bool:
    """What every span of a kind must be by its form, and by the 40 characters ``before`` it and ``around`` it; the model decides where one lies."""
    if kind == "secret":
        if len(value) < 16 or any(c.isspace() for c in value) or len(set(value)) < 6 or OTHER_WORD.search(before):
            return False
        if any(value in m[0] for m in UUID.finditer(around)):
            return False
        told = KEY_WORD.search(before) is not None
        token = before[max(before.rfind(" "), before.rfind("\n")) + 1 :]
        if "://" in token and not token.endswith("="):
            return False
        # letters, and words joined by signs, are a key only where something says so
        return told or value.startswith("AKIA") or any(c.isdigit() for c in value) or (value.isalpha() and value[1:].lower() != value[1:] and value.upper() != value and sum(a.islower() and b.isupper() for a, b in zip(value, value[1:])) >= 4)
    if kind == "email":
        words = re.sub(r"[()\[\]]", " ", value.lower())
        return "@" in value or " dot " in words and " at " in words
    n = sum("0" <= c <= "9" for c in value)
    if kind == "phone" and (OTHER_WORD.search(before) or n == 13 and ISBN.fullmatch(value)):
        return False
    if kind == "ip" and value.count(".") != 3:
        return False
    if kind == "card" and not luhn("".join(c for c in value if "0" <= c <= "9")):
        return False
    return {"phone": 7 <= n <= 15, "ip": n >= 4, "card": 13 <= n <= 19}[kind] and not any(c.isalpha() for c in value)


def formed(text: str, found: Iterator[tuple[tuple[str, int, int], float]]) -> dict[tuple[str, int, int], float]:
    """The proposals, as whole words or numbers, that may be what they are taken for."""
    out: dict[tuple[str, int, int], float] = {}
    for (kind, s, e), score in found:
        s, e = whole(text, kind, s, e)
        if plausible(kind, text[s:e], text[max(0, s - 40) : s], text[max(0, s - 40) : e + 40]):
            out[kind, s, e] = max(score, out.get((kind, s, e), score))
    return out


def best_without_overlap(found: dict[tuple[str, int, int], float], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The proposals free of ``taken`` that together score most, none overlapping another."""
    fixed = sorted((s, e) for _, s, e in taken)
    rows = sorted((e, s, k, v) for (k, s, e), v in found.items() if not any(a < e and s < b for a, b in fixed))
    ends = [r[0] for r in rows]
    total, choice = [0.0], []
    for j, (e, s, k, v) in enumerate(rows):
        before = bisect.bisect_right(ends, s, 0, j)
        choice.append(total[before] + v > total[j])
        total.append(max(total[j], total[before] + v))
    out, j = [], len(rows)
    while j:
        e, s, k, _ = rows[j - 1]
        if choice[j - 1]:
            out.append((k, s, e))
            j = bisect.bisect_right(ends, s, 0, j - 1)
        else:
            j -= 1
    return out[::-1]


def starts(n: int) -> list[int]:
    """Where the windows of a text of ``n`` characters start; the last one ends with it."""
    return [*range(0, max(1, n - WINDOW), WINDOW - 2 * MARGIN), *([n - WINDOW] if n > WINDOW else [])]


def spans_of(texts: list[str], tagger: Tagger, most: int = 512) -> list[tuple[list, list]]:
    """Base and added spans of each text; windows of many texts are scored together, ``most`` at a time."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    windows: list[tuple[int, int, int, int, int]] = []  # text, its length, start, and what of the text the window settles
    codes = np.full((most, WINDOW), PAD, np.uint8)

    def decode() -> None:
        joins = np.array([b[0] == a[0] for a, b in zip([(-1,), *windows], windows)])
        live, tags, margin = tagger.decode(codes[: len(windows)].T, joins)
        for j in np.flatnonzero(tags.any(axis=0)):
            k, n, start, a, b = windows[live[j]]
            own, sure = found.setdefault(k, (np.zeros(n, np.uint8), np.zeros(n, np.float32)))
            own[a:b], sure[a:b] = tags[a - start : b - start, j], margin[a - start : b - start, j]

    for k, text in enumerate(texts):
        whole = coded(text)
        places, n = starts(len(whole)) if text else [], len(whole)
        for j, start in enumerate(places):
            if len(windows) == most:
                decode()
                last = [windows[-1]] if j else []  # the text goes on: its last window stands beside the next one once more
                codes[: len(last)] = codes[most - len(last) : most]
                codes[len(last) :] = PAD
                windows[:] = last
            codes[len(windows), : min(WINDOW, n)] = whole[start : start + WINDOW]
            windows.append((k, n, start, start + MARGIN if j else 0, places[j + 1] + MARGIN if j + 1 < len(places) else n))
    if windows:
        decode()
    out = []
    for k, text in enumerate(texts):
        base = base_spans(text)
        good = formed(text, proposals(*found[k])) if k in found else {}
        out.append((base, best_without_overlap(good, base) if good else []))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def search(docs: DataFrame, tagger: Tagger, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, base counts, base_sha256, spans (base and added) and n_added. The model goes to every task."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in by_chars(batches):
            rows = []
            for base, added in spans_of(texts, sent.value):
                counts = [sum(k == x for k, _, _ in base) for x in BASE]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(x) for x in zip(*rows))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, last = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"<{k.upper()}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with all spans replaced; a column ``length_col``, if there is one, is counted anew."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = list(texts)
            sizes = np.cumsum([len(t or "") for t in texts]) >> 20
            groups = [list(g) for _, g in itertools.groupby(range(len(texts)), key=sizes.__getitem__)]
            found = [x for g in groups for x in spans_of([texts[i] or "" for i in g], sent.value)]
            yield pd.Series([None if t is None else redacted(t, base + added) for t, (base, added) in zip(texts, found)], dtype=object)
        give_back()

    types = dict(docs.dtypes)
    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(types[length_col])) if length_col in types else out
