"""License scans: phrases at their places, and an exact set-similarity join of text blocks with license notices.

A word is a run of bytes other than U+0000-2F, 3A-60 and 7B-7F once A-Z are lower-cased. A block is ``BLOCK`` words of a
document, each block starting ``BLOCK / 2`` words after the one before, so that a notice of up to half a block lies
whole in one. Blocks and notices are sets of word occurrences (the second "the" is a token of its own). A notice is
found where a block contains at least ``CONTAINED`` of its tokens.

The words of all notices are counted over all documents first, in one aggregation, and put in one order, the rarest
first. A block that contains enough of a notice holds one of the notice's first ``size - least + 1`` tokens (prefix
filter), has at least ``least`` words (length filter), and where their first common token stands in both tells how many
can follow (positional filter). Only what passes these is counted token by token; nothing above the threshold is missed.

Notices are a query set, sent to all tasks; ``SENT_CHARS`` bounds them, and a larger set is refused rather than cut.
Null and empty texts have no words and no labels; texts of any length are scanned whole; repeated rows each get a row;
an empty table gives none. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import by_chars, give_back
from pulsegrid.llm.decontaminate import TABLE

BLOCK = 512
CONTAINED = 0.8
SENT_CHARS = 1 << 22
#: Phrases and their labels: fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public license notices, as published with each license: fixed values.
NOTICES = {
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "boost-notice": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)""",
    "bsd-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "cc0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    "creative-commons-notice": """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
    "gnu-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "isc-permission": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "mit-permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mpl-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense-notice": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "zlib-permission": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def numbered(words: list[bytes]) -> list[tuple[bytes, int]]:
    """Each occurrence as a token: the word, and how often it stood before."""
    seen: Counter[bytes] = Counter()
    out = []
    for w in words:
        out.append((w, seen[w]))
        seen[w] += 1
    return out


@dataclass
class Notice:
    label: str
    #: The places of its tokens in the global order, rising.
    tokens: list[int]
    #: Tokens that a block must contain.
    least: int


class Index:
    """Notices by the tokens of their prefixes, in the global order that ``frequency`` gives."""

    def __init__(self, notices: dict[str, str], frequency: dict[bytes, int], contained: float = CONTAINED, block: int = BLOCK):
        self.block = block
        texts = {label: numbered(words_of(text)) for label, text in sorted(notices.items())}
        every = {t for tokens in texts.values() for t in tokens}
        # later occurrences of a word within one text are rarer than the first
        self.rank = {t: i for i, t in enumerate(sorted(every, key=lambda t: (t[1] == 0, frequency.get(t[0], 0), t)))}
        self.vocabulary = {w for w, _ in every}
        self.prefixes: dict[int, list[tuple[Notice, int]]] = defaultdict(list)
        self.rare: set[bytes] = set()
        for label, tokens in texts.items():
            if 2 * len(tokens) > block:
                raise ValueError(f"{label} has {len(tokens)} words; a block of {block} holds notices of half its length")
            least = ceil(contained * len(tokens) - 1e-9)
            prefix = sorted(tokens, key=self.rank.__getitem__)[: len(tokens) - least + 1] if tokens else []
            notice = Notice(label, sorted(map(self.rank.__getitem__, tokens)), least)
            for i, token in enumerate(prefix):
                self.prefixes[self.rank[token]].append((notice, i))
                self.rare.add(token[0])

    def blocks(self, words: list[bytes]) -> Iterator[list[bytes]]:
        step = self.block // 2
        for at in range(0, max(1, len(words) - step), step):
            yield words[at : at + self.block]

    def found(self, words: list[bytes]) -> dict[str, float]:
        """The largest containment of each notice that some block contains enough of."""
        out: dict[str, float] = {}
        if self.rare.isdisjoint(words):
            return out
        for own in self.blocks(words):
            if self.rare.isdisjoint(own):
                continue
            tokens = sorted(self.rank[t] for t in numbered([w for w in own if w in self.vocabulary]) if t in self.rank)
            held, met = set(tokens), set()
            for j, token in enumerate(tokens):
                for notice, i in self.prefixes.get(token, ()):
                    if notice.label in met or len(own) < notice.least:
                        continue
                    met.add(notice.label)  # this is the first token that they share: all others stand behind it in both
                    if min(len(notice.tokens) - i, len(tokens) - j) >= notice.least:
                        n = len(held.intersection(notice.tokens))
                        if n >= notice.least:
                            out[notice.label] = max(out.get(notice.label, 0.0), n / len(notice.tokens))
        return out


def places(words: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """Where each phrase stands: the number of its first word, and its label."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        wanted = b" " + phrase.encode() + b" "
        at, n, upto = line.find(wanted), 0, 0
        while at >= 0:
            n, upto = n + line.count(b" ", upto, at), at
            out.append((n, label))
            at = line.find(wanted, at + 1)
    return out


def frequencies(docs: DataFrame, notices: dict[str, str], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the notices stands in all documents."""
    wanted = {w for text in notices.values() for w in words_of(text)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for _, texts in by_chars(batches):
            for text in texts:
                total.update(w for w in words_of(text) if w in wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        give_back()

    rows = docs.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "word binary, n long")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row a word of the notices


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, contained: float = CONTAINED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per document: its phrases' places and what notices its blocks contain, with the share of each."""
    if sum(map(len, notices.values())) > SENT_CHARS:
        raise ValueError(f"the notices have more than {SENT_CHARS} characters; scan with a part of them at a time")
    index = Index(notices, frequencies(docs, notices, text_col), contained)
    label_type = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64())]))
    place_type = pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in by_chars(batches):
            n, at, found = [], [], []
            for text in texts:
                words = words_of(text)
                n.append(len(words))
                at.append([{"at": i, "label": label} for i, label in sorted(places(words))])
                found.append([{"label": k, "share": v} for k, v in sorted(index.found(words).items())])
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(at, place_type), pa.array(found, label_type)], ["doc_id", "n_words", "places", "notices"])
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, n_words long, places array<struct<at: long, label: string>>, notices array<struct<label: string, share: double>>")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 for a phrase, else the largest share)."""
    base = F.array_distinct(F.col("places.label"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places.at").alias("first_word"), F.array_max("places.at").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.col("notices.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.share"), F.lit(0.0))).alias("score"),
    )
