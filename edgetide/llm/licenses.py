"""Operator 10: license scans by an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import batches, slices

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Blocks of widely used notices, by label.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

#: The word that names a license. A template that has it is not found without it.
NAMES = {"gpl": "gnu", "apache": "apache", "cc-by": "creative", "mpl": "mozilla"}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


class TemplateJoin:
    """Templates and blocks as words in one global order, rarest first; the templates' prefixes in an inverted index.

    A block of a template is any run of at most floor(words of the template * den / num) consecutive words of a
    text, so its own length bounds where its words may lie. A block matches if it holds at least num / den of the template's
    distinct words, and the license's name where the template has it.
    """

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], num: int, den: int):
        own = [words(text) for _, text in templates]
        order = sorted({w for x in own for w in x}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.labels = [label for label, _ in templates]
        self.wide = [len(x) * den // num for x in own]
        self.widest = max(self.wide, default=0)
        self.sets = [sorted({self.rank[w] for w in x}) for x in own]
        self.members = [frozenset(x) for x in self.sets]
        self.need = [ceil(num * len(x) / den) for x in self.sets]
        names = [self.rank.get(NAMES.get(label, "")) for label in self.labels]
        self.name = [n if n in x else None for n, x in zip(names, self.members, strict=True)]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (x, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for at, r in enumerate(x[: len(x) - need + 1]):
                self.index.setdefault(r, []).append((t, at))
        self.rare = frozenset(order[r] for r in self.index)

    def candidates(self, stretch: list[int], positional: bool = True) -> list[int]:
        """Templates that a stretch, its words sorted by the global order, may hold to the threshold.

        Prefix: the first common word stands among a template's first size - need + 1. Length: the stretch has
        at least ``need`` of all templates' words. Position: after the first common word enough words must
        follow on both sides.
        """
        out, met = [], set()
        for j, r in enumerate(stretch):
            for t, i in self.index.get(r, ()):
                if t not in met:
                    met.add(t)
                    left = min(len(self.sets[t]) - i, len(stretch) - j)
                    if len(stretch) >= self.need[t] and (left >= self.need[t] or not positional):
                        out.append(t)
        return out

    def stretches(self, own: list[str]) -> Iterator[list[tuple[int, int]]]:
        """(place, word of a template) of every stretch that reaches as far from a prefix word as a block can.

        A matching block has a prefix word of its template, so it lies in one of them.
        """
        rank, index, reach = self.rank, self.index, self.widest
        hits = [(i, rank[w]) for i, w in enumerate(own) if w in rank]
        centres = [i for i, r in hits if r in index]
        start = at = 0
        for k, i in enumerate(centres):
            if k + 1 < len(centres) and centres[k + 1] - i < 2 * reach:
                continue
            while at < len(hits) and hits[at][0] <= centres[start] - reach:
                at += 1
            first = at
            while at < len(hits) and hits[at][0] < i + reach:
                at += 1
            yield hits[first:at]
            start = k + 1

    def most(self, t: int, stretch: list[tuple[int, int]]) -> int:
        """The most distinct words of a template that any one of its blocks has in the stretch, one pass; 0 below the need."""
        members, wide, need, name = self.members[t], self.wide[t], self.need[t], self.name[t]
        held: Counter = Counter()
        places = [(i, r) for i, r in stretch if r in members]
        best = tail = 0
        for i, r in places:
            held[r] += 1
            while places[tail][0] <= i - wide:
                out = places[tail][1]
                tail += 1
                held[out] -= 1
                if not held[out]:
                    del held[out]
            if len(held) > best and len(held) >= need and (name is None or name in held):
                best = len(held)
        return best

    def scan(self, own: list[str]) -> dict[int, float]:
        """The best containment of each template that some block of the words ``own`` matches."""
        best: dict[int, float] = {}
        if self.rare.isdisjoint(own):
            return best
        for stretch in self.stretches(own):
            for t in self.candidates(sorted({r for _, r in stretch})):
                if common := self.most(t, stretch):
                    best[t] = max(common / len(self.sets[t]), best.get(t, 0.0))
        return best


def phrases(own: list[str], table: dict[tuple[str, ...], str]) -> list[tuple[int, str]]:
    """(word index, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in table.items():
        at = -1
        for _ in range(own.count(phrase[0])):
            at = own.index(phrase[0], at + 1)
            if tuple(own[at : at + len(phrase)]) == phrase:
                out.append((at, label))
    return sorted(out)


def scan_licenses(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_words, places, matched templates, base_labels, labels, score.

    Blocks are all runs of consecutive words over the whole text, however it is wrapped, as long as the template itself
    allows (``TemplateJoin``). A template is found in a block that holds at least num / den of its distinct words, and its
    license's name if it has one. Words are ordered by how many documents of the whole corpus have them, rarest
    first (ties by word), for templates and blocks alike; prefix, length and positional filters leave few
    stretches, and the blocks in these are counted exactly. The templates are a given, short list, so
    they and their index go to every task; the corpus is read twice and nothing but the templates' word counts is
    shuffled.

    score is the best containment (1 for a base phrase), 0 without any. Null and empty texts have 0 words; texts of
    any length are scanned whole; repeated rows and null doc_ids are rows like others; other columns are not read,
    so clashing names do no harm; an empty table gives an empty result.
    """
    templates = TEMPLATES if templates is None else templates
    table = {tuple(p.split()): label for p, label in (PHRASES if base is None else base).items()}
    wanted = frozenset(w for _, t in templates for w in words(t))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in slices(parts):
            for text in b.column(0).to_pylist():
                seen.update(wanted.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    join = TemplateJoin(templates, {r["word"]: r["n"] for r in rows}, num, den)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("templates", pa.list_(pa.int32())), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc, text in zip(c["doc_id"], c["text"], strict=True):
            own = words(text)
            found = phrases(own, table)
            best = join.scan(own)
            labels = {label for _, label in found}
            for name, value in zip(out, (doc, len(own), [at for at, _ in found], sorted(best), ",".join(sorted(labels)), ",".join(sorted(labels | {join.labels[t] for t in best})), max([*best.values(), 1.0 if found else 0.0])), strict=True):
                out[name].append(value)
        return out

    return docs.select("doc_id", "text").mapInArrow(batches(run, schema), "doc_id long, n_words long, places array<long>, templates array<int>, base_labels string, labels string, score double")
