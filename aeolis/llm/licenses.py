"""License scan: template markup compiled into word automata.

In a template, [ ... ] is optional, {a b|c} is one of several wordings, and <n> stands for up
to n words of any kind; all other words are mandatory and must match exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Phrases and labels that always count (fixed values).
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Templates of license notices and of whole licenses, with the method's own labels (fixed wordings).
NOTICES = (
    ("{released|licensed|distributed|available} under the [terms of the] mit license", "mit-notice"),
    ("licensed under the apache license version 2 [0] [the license]", "apache-2-notice"),
    ("{released|licensed|distributed|available} under [the] [creative commons] cc by nc [4 0]", "cc-by-nc-notice"),
    ("licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3", "gpl-3"),
    ("all rights reserved", "all-rights-reserved"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this <12> to deal in the software without restriction", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted <6> following conditions are met", "bsd-text"),
)
_AS_IS = "including but not limited to the {warranties|implied warranties} of merchantability"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[{1|a}] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[{2|b}] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_END = (
    f"this software is provided by <12> as is and any express or implied warranties {_AS_IS} and fitness for a particular purpose are disclaimed "
    "in no event shall <12> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
    "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
    "even if advised of the possibility of such damage"
)
LICENSES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software "
        f"the software is provided as is without warranty of any kind express or implied {_AS_IS} fitness for a particular purpose and noninfringement "
        "in no event shall <12> be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "mit-license",
    ),
    (_BSD + _BSD_END, "bsd-2-clause"),
    (
        _BSD + "[{3|c}] neither the name of <12> nor the names of {its|their} contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission " + _BSD_END,
        "bsd-3-clause",
    ),
    (
        "permission to use copy modify [and] [or] distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <12> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <12> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc-license",
    ),
    (
        "licensed under the apache license version 2 0 [the license] you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at {http|https} www apache org licenses license 2 0 [{txt|html}] "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2-header",
    ),
    (
        "{this program|<6>} is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version {2|3} of the license or [at your option] any later version "
        "{this program|<6>} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details "
        "[you should have received a copy of the gnu general public license along with <6> [if not see {http|https} www gnu org licenses]]",
        "gpl-notice",
    ),
)
#: Lower-cases A-Z, keeps 0-9, a-z and bytes from 128 on, makes spaces of the others.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


class Automaton:
    """A template's states; edges go by a word, by any word, or freely."""

    def __init__(self, template: str):
        self.by_word: list[dict[bytes, list[int]]] = []
        self.by_any: list[list[int]] = []
        self.free: list[list[int]] = []
        parts = re.findall(r"[\[\]{}|]|<\d+>|[^\s\[\]{}|<>]+", template.lower())
        self.start = self.state()
        self.end, rest = self.sequence(self.start, parts)
        if rest:
            raise ValueError(f"unbalanced template: {template}")
        depth, mandatory = 0, []
        for part in parts:
            depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(part, 0)
            if not depth and part not in ("]", "}") and part[0] != "<":
                mandatory.append(part.encode())
        #: Its longest mandatory word: texts without it can't match.
        self.anchor = max(mandatory, key=len, default=b"")
        self.first = {w for s in self.closure({self.start}) for w in self.by_word[s]}
        self.starts_anywhere = any(self.by_any[s] for s in self.closure({self.start}))

    def state(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self.free.append([])
        return len(self.free) - 1

    def sequence(self, at: int, parts: list[str]) -> tuple[int, list[str]]:
        """Adds parts behind state `at`, up to a bracket or bar that closes them."""
        while parts and parts[0] not in ("]", "}", "|"):
            part, parts = parts[0], parts[1:]
            if part == "[":
                end, parts = self.sequence(at, parts)
                parts = self.closed(parts, "]")
                after = self.state()
                self.free[at].append(after)
                self.free[end].append(after)
                at = after
            elif part == "{":
                after = self.state()
                while True:
                    branch = self.state()
                    self.free[at].append(branch)
                    end, parts = self.sequence(branch, parts)
                    self.free[end].append(after)
                    if not parts or parts[0] != "|":
                        break
                    parts = parts[1:]
                parts = self.closed(parts, "}")
                at = after
            elif part[0] == "<":
                after = self.state()
                for _ in range(int(part[1:-1])):
                    self.free[at].append(after)
                    following = self.state()
                    self.by_any[at].append(following)
                    at = following
                self.free[at].append(after)
                at = after
            else:
                after = self.state()
                self.by_word[at].setdefault(part.encode(), []).append(after)
                at = after
        return at, parts

    @staticmethod
    def closed(parts: list[str], bracket: str) -> list[str]:
        if not parts or parts[0] != bracket:
            raise ValueError(f"{bracket} is missing")
        return parts[1:]

    def closure(self, states: set[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest match that starts at word `at`; -1 if none does."""
        states, end = self.closure({self.start}), -1
        while True:
            if self.end in states:
                end = at
            if at == len(words) or not states:
                return end
            word = words[at]
            states = self.closure({t for s in states for t in (*self.by_word[s].get(word, ()), *self.by_any[s])})
            at += 1

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, end) at every word where the template matches."""
        for at, word in enumerate(words):
            if (word in self.first or self.starts_anywhere) and (end := self.longest(words, at)) > at:
                yield at, end


class Template(NamedTuple):
    label: str
    base: bool
    automaton: Automaton


def scan(docs: DataFrame, base: tuple = BASE, notices: tuple = NOTICES + LICENSES) -> DataFrame:
    """(doc_id, n_words, matches) of every document; matches: structs (label, base, start, end).

    Words are runs of A-Z (lower-cased), 0-9 and characters beyond ASCII, numbered from 0.
    A match is listed for every word at which a template's mandatory wording starts, with the
    longest end. A null or empty text has no words and no matches; long ones are scanned whole,
    word by word. Rows are looked at one by one, so repeated rows and null ids come out as they went in, and other columns don't matter.
    """
    templates = [Template(label, kind, Automaton(t)) for kind, group in ((True, base), (False, notices)) for t, label in group]
    match = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])

    def matches(text: bytes) -> tuple[int, list[dict]]:
        folded = text.translate(_FOLD)
        words, found = folded.split(), []
        for t in templates:
            if t.automaton.anchor in folded:
                found += [{"label": t.label, "base": t.base, "start": a, "end": b} for a, b in t.automaton.matches(words)]
        return len(words), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [matches(x or b"") for x in batch.column(1).to_pylist()]
            n, found = [r[0] for r in rows], [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(match))], names=["doc_id", "n_words", "matches"])

    schema = "doc_id long, n_words long, matches array<struct<label: string, base: boolean, start: long, end: long>>"
    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))).mapInArrow(run, schema)


def summary(scanned: DataFrame) -> DataFrame:
    """Per document its base matches and labels, and a score: 1 for a whole notice, 0.5 for a base phrase alone, else 0."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    score = F.when(F.exists("matches", lambda m: ~m["base"]), 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0)
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        score.alias("score"),
    )
