"""License scans by template markup: optional and replaceable regions compiled to token automata.

A template is the public wording of a licence or notice with the markup ``[[...]]`` for regions that
may be left out and ``{{n}}`` for up to n words of any kind (names, years). It compiles to an
automaton over words; a document is accepted where a stretch of its words takes the automaton from
its start to its end, so mandatory wording must match word by word. Documents are scanned in the
tasks that read them; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quantloom.llm.common import binary, words_of

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence wordings with markup, to the last word of each.
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that
    the following conditions are met [[1]] redistributions of source code must retain the above copyright notice
    this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the
    above copyright notice this list of conditions and the following disclaimer in the documentation and or other
    materials provided with the distribution"""
_BSD_ADVERTISING = """[[3]] all advertising materials mentioning features or use of this software must display the following
    acknowledgement this product includes software developed by {{16}}"""
_BSD_NAMES = """neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission"""
_BSD_END = """this software is provided by {{12}} as is and any express or implied warranties including but not limited to the
    implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be
    liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
    procurement of substitute goods or services loss of use data or profits or business interruption however caused and
    on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
    any way out of the use of this software even if advised of the possibility of such damage"""
TEMPLATES = {
    "mit-notice": "[[this [[software]] [[project]] [[work]] is]] released under the [[terms of the]] mit license",
    "apache-notice": "licensed under the [[terms of the]] apache license [[version 2 0]]",
    "gpl-notice": "[[this [[program]] [[software]] [[work]] is]] [[distributed]] [[licensed]] [[covered]] under the [[terms of the]] gnu general public license",
    "cc-by-notice": "[[this {{2}} is]] [[licensed]] [[released]] [[available]] under [[a]] [[the]] cc by {{1}} 0 [[license]]",
    "cc-by-nc-notice": "[[this {{2}} is]] [[licensed]] [[released]] [[available]] under [[a]] [[the]] cc by nc {{1}} 0 [[license]]",
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of {{4}} software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice [[including the next paragraph]] shall be included in all copies or
        substantial portions of the software the software is provided as is without warranty of any kind express or
        implied including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall {{12}} be liable for any claim damages or other liability whether in an action
        of contract tort or otherwise arising from out of or in connection with the software or the use or other
        dealings in the software""",
    "isc": """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties
        of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or
        consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action
        of contract negligence or other tortious action arising out of or in connection with the use or performance of
        this software""",
    "apache-2.0": """licensed under the apache license version 2 0 the license you may not use this {{3}} except in
        compliance with the license you may obtain a copy of the license at [[http]] [[https]] [[www]] apache org
        licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the
        license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
    "gpl-or-later": """this program is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version {{2}} of the license or at
        your option any later version this program is distributed in the hope that it will be useful but without any
        warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
        general public license for more details you should have received a copy of the gnu general public license along
        with this program""",
    "bsd-2-clause": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} [[3]] {_BSD_NAMES} {_BSD_END}",
    "bsd-4-clause": f"{_BSD} {_BSD_ADVERTISING} [[4]] {_BSD_NAMES} {_BSD_END}",
    "cc-by-4.0": "[[this {{3}} is]] licensed under [[a]] [[the]] creative commons attribution 4 0 international license",
}


class Automaton:
    """States 0 .. end; ``arcs[s]`` maps a word to states, ``free[s]`` goes on with any word,
    ``skip[s]`` goes on with none."""

    def __init__(self, template: str):
        self.arcs: list[dict[bytes, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]
        self.skip: list[list[int]] = [[]]
        opened, at = [], 0
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                self.skip[opened.pop()].append(at)
            elif part.startswith("{{"):
                begins = at
                for _ in range(int(part[2:-2])):
                    new = self.state()
                    self.free[at].append(new)
                    at = new
                for s in range(begins, at):
                    self.skip[s].append(at)
            else:
                for word in words_of(part.encode()):
                    new = self.state()
                    self.arcs[at].setdefault(word, []).append(new)
                    at = new
        self.end = at
        self.begin = self.closed([0])
        self.first = {w for s in self.begin for w in self.arcs[s]}
        if any(self.free[s] for s in self.begin):
            raise ValueError("a template begins with wording, not with a free region")

    def state(self) -> int:
        self.arcs.append({})
        self.free.append([])
        self.skip.append([])
        return len(self.arcs) - 1

    def closed(self, states: list[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether a stretch that begins at ``start`` matches."""
        states = self.begin
        for i in range(start, len(words)):
            if self.end in states:
                return True
            word = words[i]
            states = self.closed([t for s in states for t in (*self.arcs[s].get(word, ()), *self.free[s])])
            if not states:
                return False
        return self.end in states


def compiled(templates: dict[str, str]) -> dict[bytes, list[tuple[str, Automaton]]]:
    """Automata by the words with which a match can begin."""
    by_word: dict[bytes, list[tuple[str, Automaton]]] = {}
    for label, template in templates.items():
        automaton = Automaton(template)
        for word in automaton.first:
            by_word.setdefault(word, []).append((label, automaton))
    return by_word


def scanned(text: bytes | None, phrases: dict, by_word: dict) -> tuple[int, list[int], set[str], set[str]]:
    """Words, starts of phrases, labels of phrases, labels of accepted templates."""
    words = words_of(text)
    starts, base, own = [], set(), set()
    heads = phrases.keys() | by_word.keys()
    for i, word in enumerate(words):
        if word not in heads:
            continue
        for phrase, label in phrases.get(word, ()):
            if words[i : i + len(phrase)] == phrase:
                starts.append(i)
                base.add(label)
        for label, automaton in by_word.get(word, ()):
            if label not in own and automaton.accepts(words, i):
                own.add(label)
    return len(words), starts, base, own


def license_labels(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels and score (1 with an accepted template, 0.5 with phrases only, else 0).

    Null and empty texts have no words and no labels; repeated rows have a row each; an empty table
    gives none; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = compiled(templates)
        heads: dict[bytes, list] = {}
        for phrase, label in phrases.items():
            words = words_of(phrase.encode())
            heads.setdefault(words[0], []).append((words, label))
        for batch in batches:
            out = []
            for text in binary(batch.column("text")):
                n, starts, base, own = scanned(text, heads, by_word)
                ends = (min(starts), max(starts)) if starts else (None, None)
                score = 1.0 if own else 0.5 if base else 0.0
                out.append((n, len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(base | own)), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)
