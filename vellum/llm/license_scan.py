"""License scans by template-markup matching.

A template is licence wording with markup: {{...}} encloses an optional region, and
[[n]] stands for a replaceable region of at most n words. Templates are compiled into
automata over words; a text holds a licence if some run of its words is accepted, that
is, if all mandatory wording is there, word for word and in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import map_arrow

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The wording of public licences and of the notices that they ask for, as templates, whole. A label may have several.
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice {{including the next paragraph}} shall be included in all copies or substantial portions of the software"
_NO_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall [[6]] authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {{1}} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {{2}} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "{{3}} neither the name of [[12]] nor the names of {{its}} {{his}} {{their}} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = "this software is provided by [[12]] as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall [[12]] be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GPL = "{{this program}} [[6]] is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version {{this program}} [[6]] is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {2} for more details"
TEMPLATES = [
    ("mit", f"{_GRANT} {_NO_WARRANTY}"),
    ("mit", "{{this}} {{software}} {{code}} {{project}} {{work}} {{file}} {{is}} licensed under the {{terms of the}} mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{http}} {{https}} www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "licensed under {{the}} {{terms of the}} apache license {{version}} 2 {{0}}"),
    ("bsd-2", f"{_BSD} {_BSD_DISCLAIMER}"),
    ("bsd-3", f"{_BSD} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and [[8]] disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall [[8]] be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("gpl-2", _GPL.replace("{0}", "general public license").replace("{1}", "2").replace("{2}", "general public license")),
    ("gpl-3", _GPL.replace("{0}", "general public license").replace("{1}", "3").replace("{2}", "general public license")),
    ("lgpl-3", _GPL.replace("{0}", "lesser general public license").replace("{1}", "3").replace("{2}", "lesser general public license")),
    ("agpl-3", _GPL.replace("{0}", "affero general public license").replace("{1}", "3").replace("{2}", "affero general public license")),
    ("gpl-3", "licensed under the {{terms of the}} gnu general public license {{as published by the free software foundation}} {{either}} {{v3}} {{version 3}} {{or later}}"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{http}} {{https}} mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by", "licensed under {{a}} {{the}} creative commons attribution {{4 0}} international {{public}} license"),
    ("cc-by-nc", "licensed under {{a}} {{the}} creative commons attribution noncommercial {{4 0}} {{international}} {{public}} license"),
    ("cc-by-nc", "licensed under {{a}} {{the}} {{creative commons}} cc by nc {{4 0}} {{international}} {{license}}"),
    ("all-rights-reserved", "copyright {{c}} [[10]] all rights reserved"),
]

#: Bytes that are no part of a word become spaces, A-Z lower case; all bytes from 0x80 belong to words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass(frozen=True)
class Automaton:
    """A nondeterministic automaton: state p stands before place p of the template and is bit p of a set of states.

    steps: word -> the places that it satisfies; any: the places that any word satisfies;
    skips: (from, to) of regions that may be left out, in the order of `from`.
    """

    label: str
    steps: dict[bytes, int]
    any: int
    skips: tuple[tuple[int, int], ...]
    end: int
    anchor: bytes

    def closed(self, states: int) -> int:
        for start, stop in self.skips:
            if states >> start & 1:
                states |= 1 << stop
        return states

    def accepts(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run that begins at word `start`, or -1."""
        states, found = self.closed(1), -1
        for i in range(start, len(words)):
            states = self.closed((states & (self.steps.get(words[i], 0) | self.any)) << 1)
            if not states:
                break
            if states >> self.end & 1:
                found = i + 1
        return found

    def starts(self) -> set[bytes]:
        first = self.closed(1)
        return {w for w, places in self.steps.items() if places & first}


def compile_template(label: str, markup: str) -> Automaton:
    """The anchor is the longest mandatory run of words, between spaces: a text without it can't match."""
    steps: dict[bytes, int] = {}
    anything, place, skips, opened = 0, 0, [], None
    runs, run = [], []
    for token in re.findall(r"\{\{|\}\}|\[\[\d+\]\]|[^\s{}\[\]]+", markup):
        if token == "{{":
            opened = place
            runs, run = [*runs, run], []
        elif token == "}}":
            skips.append((opened, place))
            opened = None
        elif token.startswith("[["):
            runs, run = [*runs, run], []
            for _ in range(int(token[2:-2])):
                anything |= 1 << place
                skips.append((place, place + 1))
                place += 1
        else:
            for word in words_of(token.encode()):
                steps[word] = steps.get(word, 0) | 1 << place
                place += 1
                if opened is None:
                    run = [*run, word]
    anchor = max([*runs, run], key=lambda r: sum(map(len, r)))
    if not anchor or anything & 1:
        raise ValueError(f"template {label!r} needs mandatory words and may not begin with a replaceable region")
    return Automaton(label, steps, anything, tuple(sorted(skips)), place, b" " + b" ".join(anchor) + b" ")


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    found, n, at = [], len(phrase), -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return found
        if words[at : at + n] == phrase:
            found.append(at)


def scan(text: bytes | None, phrases: list[tuple[bytes, list[bytes], str]], automata: list[Automaton]) -> dict:
    """All that the operator returns of one text."""
    words = words_of(text or b"")
    line = b" " + b" ".join(words) + b" "
    places = [(p, label) for joined, phrase, label in phrases if joined in line for p in phrase_places(words, phrase)]
    spans = []
    for a in automata:
        if a.anchor not in line:
            continue
        first, at = a.starts(), 0
        while at < len(words):
            end = a.accepts(words, at) if words[at] in first else -1
            if end > 0:
                spans.append((a.label, at, end))
            at = max(at + 1, end)
    base = {label for _, label in places}
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min((p for p, _ in places), default=None), "last_word": max((p for p, _ in places), default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s[0] for s in spans})), "score": 1.0 if spans else 0.5 if base else 0.0,
        "spans": [{"label": s[0], "start": s[1], "stop": s[2]} for s in spans],
    }


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPANS}


def license_scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row per input row.

    Words are runs of digits, a-z (after lower-casing A-Z) and all characters from U+0080.
    The base counts places where a phrase's words stand consecutively. `labels` adds those
    of accepted templates; `spans` are their word ranges. score: 1 with an accepted
    template, 0.5 with base phrases only, else 0.

    * null or empty text: no words, no labels ('' in both columns), null places, score 0.
    * null doc_ids and repeated rows pass through, a row each.
    * ties: of runs that begin at one word, the longest is the template's; all templates report theirs.
    * texts are scanned whole, whatever their length, one at a time.
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    lines = [(b" " + p.encode() + b" ", p.encode().split(), label) for p, label in phrases.items()]
    automata = [compile_template(*t) for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t, lines, automata) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], kind) for k, kind in _TYPES.items()]], names=["doc_id", *_TYPES])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text")), run, f"doc_id long, {FIELDS}")
