"""Licence scans: a generalised suffix automaton of licence wording, matching statistics, chains of long matches.

All templates and the base phrases are inserted, word by word, into one automaton. A text streams through it: after every
word the automaton knows the longest run of words ending there that any template holds. Runs that can't be extended and
are long enough are places of templates; those of one template that follow each other in the text and in the template
are chained, and a chain that covers enough of its template labels the text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import pieces, tidy

#: Bytes of a text that are split into words at once.
STREAM_BYTES = 1 << 20

# The phrases that count as base labels, and the wording of public licences.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
        "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
    ),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class LicenseRules:
    #: Runs of fewer words are no matches; a shorter template must match as a whole.
    least_match: int = 6
    #: Words of the text that two matches of a chain may lie apart.
    most_gap: int = 40
    #: Share of a template that a chain must cover to label the text.
    least_cover: float = 0.6


#: A-Z to lower case; what is neither digit, letter nor a byte of a longer character to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes, at_once: int = STREAM_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in its order, a list for each part of it; no word is cut in two."""
    rest = b""
    for start in range(0, len(text), at_once):
        part = rest + text[start : start + at_once].translate(FOLD)
        if start + at_once < len(text):
            cut = part.rfind(b" ") + 1
            part, rest = part[:cut], part[cut:]
        yield part.split()


@dataclass
class Scan:
    """What one text holds. ``spans``: label, first and last word, share of the template."""

    n_words: int = 0
    n_base: int = 0
    first: int | None = None
    last: int | None = None
    base: set[str] = field(default_factory=set)
    spans: list[tuple[str, int, int, float]] = field(default_factory=list)
    score: float = 0.0


class TemplateAutomaton:
    """The suffix automaton of all templates and phrases: every run of words in any of them leads to one state.

    ``after``: the state after one more word; ``link``: that of the longest shorter ending which occurs in other places
    too; ``length``: words of the longest run of a state; ``ends``: templates and places where its runs end.
    """

    def __init__(self, templates: Iterable[tuple[str, str]] = TEMPLATES, phrases: Iterable[tuple[str, str]] = BASE_PHRASES, rules: LicenseRules = LicenseRules()):
        self.rules = rules
        self.after: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        wordings = [(label, [w for part in words_of(text.encode()) for w in part]) for label, text in templates]
        self.templates = [(label, len(words)) for label, words in wordings if words]
        self.least = [min(rules.least_match, n) for _, n in self.templates]
        self.shortest = min(self.least, default=1 << 60)
        runs = [words for _, words in wordings if words]
        sought = [(label, [w for part in words_of(text.encode()) for w in part]) for text, label in phrases]
        for words in [*runs, *(words for _, words in sought)]:
            last = 0
            for word in words:
                last = self._extended(last, word)
        longest_first = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for k, words in enumerate(runs):
            for place, state in enumerate(self._path(words)):
                self.ends[state].append((k, place))
        for state in longest_first:
            self.ends[self.link[state]] += self.ends[state]
        self.ends = [sorted(set(x)) for x in self.ends]
        #: Phrases that end wherever a state is reached by as many words at least.
        self.phrases: list[tuple[tuple[int, str], ...]] = [() for _ in self.length]
        for label, words in sought:
            state = self._path(words)[-1]
            self.phrases[state] += ((len(words), label),)
        for state in reversed(longest_first):
            self.phrases[state] += self.phrases[self.link[state]]

    def _state(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, before: int, word: bytes) -> int:
        """The state of exactly the longest run of ``before`` and ``word``: a copy is made if longer runs share it."""
        there = self.after[before][word]
        if self.length[there] == self.length[before] + 1:
            return there
        copy = self._state(self.length[before] + 1, self.link[there], dict(self.after[there]))
        self.link[there] = copy
        while before >= 0 and self.after[before].get(word) == there:
            self.after[before][word] = copy
            before = self.link[before]
        return copy

    def _extended(self, last: int, word: bytes) -> int:
        if word in self.after[last]:
            return self._split(last, word)
        new, before = self._state(self.length[last] + 1, 0, {}), last
        while before >= 0 and word not in self.after[before]:
            self.after[before][word] = new
            before = self.link[before]
        if before >= 0:
            self.link[new] = self._split(before, word)
        return new

    def _path(self, words: list[bytes]) -> list[int]:
        states, at = [], 0
        for word in words:
            at = self.after[at][word]
            states.append(at)
        return states

    def scan(self, text: bytes) -> Scan:
        """Base phrases, and the spans of templates. Parts of the text pass by; only chains still open are held."""
        found, chains = Scan(), Chains(self)
        after, link, length, phrases, shortest = self.after, self.link, self.length, self.phrases, self.shortest
        state = run = 0
        place = -1
        for words in words_of(text):
            for word in words:
                place += 1
                to = after[state].get(word)
                if to is None:
                    if not state:
                        continue
                    if run >= shortest:
                        chains.add(place - 1, run, state)
                    while state and to is None:
                        state = link[state]
                        to = after[state].get(word)
                    run = length[state]
                    if to is None:
                        continue
                state = to
                run += 1
                for n, label in phrases[state]:
                    if run >= n:
                        start = place - n + 1
                        found.n_base += 1
                        found.first = start if found.first is None else min(found.first, start)
                        found.last = start if found.last is None else max(found.last, start)
                        found.base.add(label)
        if run >= shortest:
            chains.add(place, run, state)
        found.n_words = place + 1
        found.spans, found.score = chains.ended()
        return found


class Chains:
    """Chains of matches that follow each other in the text and in one template.

    A chain is worth the words of the template that it covers. It stays open for ``most_gap`` words of the text; each new
    match continues the open chain that it makes worth most. Of chains of a template that overlap in the text the one of
    most worth becomes a span; of equal ones the earlier.
    """

    def __init__(self, automaton: TemplateAutomaton):
        self.automaton, self.rules = automaton, automaton.rules
        #: By template: covered words, first word, last word, last word in the template.
        self.open: dict[int, deque[tuple[int, int, int, int]]] = {}
        self.spans: dict[int, list[tuple[int, int, int]]] = {}
        self.score = 0.0

    def add(self, end: int, run: int, state: int) -> None:
        for template, place in self.automaton.ends[state]:
            if run < self.automaton.least[template]:
                continue
            chains, start = self.open.setdefault(template, deque()), end - run + 1
            while chains and chains[0][2] < start - 1 - self.rules.most_gap:
                chains.popleft()
            best = (run, start, end, place)
            for worth, first, last, last_place in chains:
                gain = min(run, end - last, place - last_place)
                if gain > 0 and worth + gain > best[0]:
                    best = (worth + gain, first, end, place)
            chains.append(best)
            self._reached(template, *best[:3])

    def _reached(self, template: int, worth: int, first: int, last: int) -> None:
        share = worth / self.automaton.templates[template][1]
        self.score = max(self.score, share)
        if share < self.rules.least_cover:
            return
        spans = self.spans.setdefault(template, [])
        overlapping = len(spans)
        while overlapping and spans[overlapping - 1][2] >= first:
            overlapping -= 1
        if all(worth > other[0] for other in spans[overlapping:]):
            spans[overlapping:] = [(worth, first, last)]

    def ended(self) -> tuple[list[tuple[str, int, int, float]], float]:
        """Spans by place, and the largest share of a template that any chain covers."""
        named = self.automaton.templates
        spans = [(named[k][0], first, last, worth / named[k][1]) for k, found in self.spans.items() for worth, first, last in found]
        return sorted(spans, key=lambda s: (s[1], s[2], s[0], s[3])), self.score


def scan_licenses(docs: DataFrame, automaton: TemplateAutomaton | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base phrases, labels and template spans of every whole text.

    Returns id, ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and ``last_word`` (their smallest and
    largest start, words counted from 0; null without one), ``base_labels`` and ``labels`` (distinct, sorted, joined by
    commas; empty without one), ``score`` (the largest share of a template that a chain covers) and ``spans`` (label, first
    and last word, share). Null and empty texts have no words; repeated rows get equal results; an empty table gives no
    rows; other columns are not carried. The automaton is built once and sent with the function: it grows with the
    templates only. A text streams through in parts of a megabyte.
    """
    automaton = automaton or TemplateAutomaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "first_word", "last_word", "share"]
        span = pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)))
        for batch in pieces(batches):
            found = [automaton.scan(text or b"") for text in batch.column(1).cast(pa.binary()).to_pylist()]
            long = lambda values: pa.array(values, pa.int64())
            base = [",".join(sorted(f.base)) for f in found]
            labels = [",".join(sorted(f.base.union(s[0] for s in f.spans))) for f in found]
            columns = [
                long([f.n_words for f in found]), long([f.n_base for f in found]), long([f.first for f in found]), long([f.last for f in found]),
                pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array([f.score for f in found], pa.float64()),
                pa.array([[dict(zip(names, s, strict=True)) for s in f.spans] for f in found], pa.list_(span)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *shape])

    shape = {
        "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string",
        "score": "double", "spans": "array<struct<label: string, first_word: long, last_word: long, share: double>>",
    }
    kind = docs.schema[id_col].dataType.simpleString()
    returned = ", ".join([f"id {kind}", *(f"{n} {t}" for n, t in shape.items())])
    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return rows.mapInArrow(tidy(run), returned).withColumnRenamed("id", id_col)
