"""License scans: templates with optional and replaceable regions, compiled into automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.common import texts_of

#: Phrases that count as places, and the label each gives.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_GRANT = "((licensed|released|distributed|modify it|available))"
#: Versions of licenses that come in families, and wordings of their names.
CC = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
GNU = {"gpl": ("general", ("2.0", "3.0")), "lgpl": ("lesser general", ("2.1", "3.0")), "agpl": ("affero general", ("3.0",))}


def _tag(name: str) -> str:
    """The line by which source files name their license."""
    return f"spdx license identifier {name.replace('-', ' ').replace('.', ' ')}"


def _families() -> tuple[tuple[str, str], ...]:
    cc = [(f"cc-{k}-{v}", f"licensed under [[a]] [[the]] ((cc {k}|creative commons cc {k}|creative commons {name})) {v} [[international|unported|generic]] [[public]] [[license]]") for k, name in CC.items() for v in CC_VERSIONS]
    gnu = []
    for k, (name, versions) in GNU.items():
        for v in versions:
            short = v.removesuffix(".0")
            later = "[[((only|or later|or at your option any later version))]]"
            version = f"((version {short}|v{short}|{short})) [[0]] [[of the license]] {later}"
            gnu.append((f"{k}-{v}", f"[[this work is]] {_GRANT} under the [[terms of the]] gnu {name} public license [[as published by the free software foundation]] [[either]] {version}"))
            gnu.append((f"{k}-{v}", f"gnu {k} {version}"))
            gnu.append((f"{k}-{v}", f"{_tag(f'{k}-{v}')} {later}"))
    return (*cc, *gnu)


_NO_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
_NO_CLAIM = "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by {{1..12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1..12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "the software is provided as is and {{1..8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{1..8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"

#: Label and template. A label ending in -text stands for the whole wording of a license, disclaimer included; -title for the head
#: of one whose text is long (the whole can be given by from_spdx); others for notices, names and tags. [[words]] may be left out, ((a|b c)) is
#: one of its alternatives, [[a|b]] one or none, {{a..b}} stands for a to b words of any kind, the rest is
#: mandatory word for word. Letter case, punctuation and white space don't matter. from_spdx reads the public template markup.
TEMPLATES = (
    ("apache-2.0", "((licensed|released|distributed|available)) under [[the terms of]] the apache [[software]] license [[version]] 2 [[0]]"),
    ("apache-2.0", _tag("apache-2.0")),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{0..2}} www apache org licenses license 2 0 [[txt]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("apache-2.0-title", "apache license version 2 0 january 2004 [[http www apache org licenses]] terms and conditions for use reproduction and distribution"),
    *_families(),
    ("gpl-title", "gnu general public license version ((2 june 1991|3 29 june 2007)) copyright c {{1..20}} everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl-title", "gnu ((lesser|library)) general public license version ((2 june 1991|2 1 february 1999|3 29 june 2007)) copyright c {{1..20}} everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl-2.0", f"{_GRANT} under the [[terms of the]] gnu library general public license [[as published by the free software foundation]] [[either]] ((version 2|v2)) [[0]] [[of the license]] [[or at your option any later version]]"),
    ("lgpl-2.0", f"{_tag('lgpl-2.0')} [[((only|or later))]]"),
    ("agpl-title", "gnu affero general public license version 3 19 november 2007 copyright c {{1..20}} everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", _tag("mpl-2.0")),
    ("epl-2.0", "made available under the terms of the eclipse public license [[v]] 2 0"),
    ("epl-2.0", _tag("epl-2.0")),
    ("mit", "[[this work is]] {{0..1}} under the [[terms of the]] mit license"),
    *[(name.lower(), _tag(name)) for name in ("mit", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "zlib", "bsl-1.0", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0")],
    ("all-rights-reserved", "[[copyright {{0..8}}]] all rights reserved"),
    (
        "mit-text",
        f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {_NO_WARRANTY} and noninfringement in no event shall {{{{1..12}}}} {_NO_CLAIM}",
    ),
    ("isc-text", f"{_ISC} provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}"),
    ("0bsd-text", f"{_ISC} {_ISC_END}"),
    ("bsd-2-text", f"{_BSD} {_BSD_END}"),
    (
        "bsd-3-text",
        f"{_BSD} [[3]] neither the name of {{{{1..12}}}} nor the names of [[its]] contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    ),
    (
        "bsl-1.0-text",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor "
        + _NO_WARRANTY
        + " title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "unlicense-text",
        f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_NO_WARRANTY} and noninfringement in no event shall the authors {_NO_CLAIM}",
    ),
    ("cc0-notice", "to the extent possible under law {{1..12}} ((has|have)) waived all copyright and related or neighboring rights to"),
)

_MARKUP = re.compile(r"\[\[|\]\]|\(\(|\)\)|\||\{\{\d+\.\.\d+\}\}|[^\s\[\]{}()|]+")


def from_spdx(text: str, most_words: int = 60) -> str:
    """Markup of a license template in the public SPDX form: <<beginOptional>> and <<endOptional>>, and <<var;name=..;original=..;match=..>>
    whose pattern is any text (.+ or .* for up to most_words words, .{a,b} for up to b) or literal alternatives (a|b)."""

    def variable(m: re.Match) -> str:
        pattern = (re.search(r'match="([^"]*)"', m[1]) or [None, ".+"])[1]
        if any_ := re.fullmatch(r"\.(\+|\*|\{(\d+),(\d+)\})", pattern):
            least, most = (int(any_[1] == "+"), most_words) if any_[3] is None else (min(1, int(any_[2])), min(int(any_[3]), most_words))
            return f" {{{{{least}..{most}}}}} "
        plain = pattern.strip("()").replace("\\", "")
        if re.search(r"[\[\]{}()*+?^$]", plain):
            raise ValueError(f"no template pattern: {pattern}")
        return f" (({'|'.join(re.sub(r'[^0-9A-Za-z\x80-\U0010ffff]', ' ', x) for x in plain.split('|'))})) "

    out = []
    for part in re.split(r"(<<[^>]*(?:>(?!>)[^>]*)*>>)", text):
        if part.startswith("<<beginOptional"):
            out.append(" [[ ")
        elif part.startswith("<<endOptional"):
            out.append(" ]] ")
        elif part.startswith("<<var"):
            out.append(variable(re.fullmatch(r"<<(.*)>>", part, re.S)))
        else:
            out.append(re.sub(r"[\[\](){}|]", " ", part))
    return " ".join("".join(out).split())


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text: runs of digits, letters and everything beyond ASCII, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Template:
    """An automaton over words.

    States are places in the template. A mandatory word is a step that consumes that word; an optional region adds a
    step past it that consumes nothing; alternatives leave one state and meet in one; a replaceable region of a to b words is a chain of b steps that
    consume any word, of which all but the first a may be passed for nothing. The longest run of
    mandatory words that no region breaks is in every accepted text, so texts without it are not walked.
    """

    def __init__(self, label: str, markup: str):
        self.label = label
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        runs: list[list[bytes]] = [[]]
        opened: list[tuple[str, int, list[int]]] = []  # how a region began, its first state, and where alternatives so far end
        for token in _MARKUP.findall(markup):
            at = len(self.steps) - 1
            if token in ("[[", "(("):
                opened.append((token, at, []))
                self._state(at)
                runs.append([])
            elif token == "|":
                if not opened:
                    raise ValueError(f"{label}: | outside of a region")
                opened[-1][2].append(at)
                self._state(opened[-1][1])
            elif token in ("]]", "))"):
                if not opened or opened[-1][0] != {"]]": "[[", "))": "(("}[token]:
                    raise ValueError(f"{label}: {token} without its beginning")
                _, start, ends = opened.pop()
                end = self._state(at)
                for e in [*ends, *[start] * (token == "]]")]:
                    self.free[e].append(end)
                runs.append([])
            elif token.startswith("{{"):
                least, most = map(int, token[2:-2].split(".."))
                for k in range(most):
                    at = self._add(None)
                    if k >= least:
                        self.free[at - 1].append(at)
                runs.append([])
            else:
                for word in words_of(token):
                    self._add(word)
                    if not opened:
                        runs[-1].append(word)
        if opened:
            raise ValueError(f"{label}: {opened[-1][0]} without its end")
        self.end = len(self.steps) - 1
        self.anchor = max(runs, key=lambda r: (len(r), sum(map(len, r))))
        self.told_by = max(self.anchor, key=len, default=b"")  # of the anchor's words the longest, as long words are rare
        self.mandatory = sum(map(len, runs))
        if not self.anchor:
            raise ValueError(f"{label}: no mandatory words")
        self.start = self._close({0})
        if self.end in self.start:
            raise ValueError(f"{label}: accepts an empty text")
        self._next: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}
        self._words = {w for s in self.steps for w, _ in s if w}

    def _state(self, after: int) -> int:
        """A new state that is reached from another for nothing."""
        self.steps.append([])
        self.free.append([])
        self.free[after].append(len(self.steps) - 1)
        return len(self.steps) - 1

    def _add(self, word: bytes | None) -> int:
        self.steps.append([])
        self.free.append([])
        self.steps[-2].append((word, len(self.steps) - 1))
        return len(self.steps) - 1

    def _close(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        """The automaton's states after a word; the deterministic automaton is built as it is walked."""
        word = word if word in self._words else b""
        if (states, word) not in self._next:
            self._next[states, word] = self._close({to for s in states for w, to in self.steps[s] if w is None or w == word})
        return self._next[states, word]

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words that starts at a place, or -1."""
        states, end = self.start, -1
        while at < len(words) and states:
            states = self.step(states, words[at])
            at += 1
            if self.end in states:
                end = at
        return end

    def find(self, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """Accepted runs (start, end), from left to right, none inside another: the longest from each place not yet covered.
        joined is the words with a space around each."""
        if b" " + b" ".join(self.anchor) + b" " not in joined:
            return []
        out, at = [], 0
        while at < len(words):
            if (end := self.longest(words, at)) > 0:
                out.append((at, end))
                at = end
            else:
                at += 1
        return out


class Anchors:
    """Which of many templates a text may hold: an index of the longest word of each anchor, so that a text costs by its own words."""

    def __init__(self, templates: list[Template]):
        self.by_word: dict[bytes, list[tuple[int, Template]]] = {}
        for k, t in enumerate(templates):
            self.by_word.setdefault(t.told_by, []).append((k, t))
        self.words = frozenset(self.by_word)

    def of(self, words: list[bytes]) -> list[Template]:
        """The templates whose anchor has its longest word in words, in their order."""
        return [t for _, t in sorted((x for w in self.words.intersection(words) for x in self.by_word[w]), key=lambda x: x[0])]


def _places(words: list[bytes], joined: bytes, phrase: list[bytes]) -> list[int]:
    """Words at which the phrase starts, overlaps included."""
    text, out, at, word = b" " + b" ".join(phrase) + b" ", [], 0, 0
    found = joined.find(text)
    while found >= 0:
        word += joined.count(b" ", at, found)
        out.append(word)
        at = found
        found = joined.find(text, found + 1)
    return out


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,mandatory:long>>"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """For each row of docs (doc_id, text): its words, base phrases, labels, score and the spans that templates accept.

    n_base counts the places of all base phrases; first_word and last_word are the smallest and largest of them.
    labels are the base labels and those of templates with an accepted run of words anywhere in the text. spans has
    each accepted run with its template's number of mandatory words. score: 1 if a template accepts, 0.5 if only base
    phrases are there, 0 if nothing is.
    Nulls: a null text is empty: no words, empty labels, score 0. A null doc_id stays. Repeated rows are scanned each. A text of any
    length is scanned whole, in one worker. An empty table gives no rows. Other columns are not read.
    """
    built = Anchors([Template(*t) for t in templates])
    phrases = [(words_of(p), label) for p, label in base.items()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in re.sub("<[^>]*>+", "", SCANNED).split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                some = b.slice(at, 2000)
                rows = []
                for text in texts_of(some.column(1)):
                    words = words_of(text)
                    joined = b" " + b" ".join(words) + b" "
                    places, own = [], set()
                    for phrase, label in phrases:
                        if found := _places(words, joined, phrase):
                            places += found
                            own.add(label)
                    spans = [{"label": t.label, "start": s, "end": e, "mandatory": t.mandatory} for t in built.of(words) for s, e in t.find(words, joined)]
                    labels = own | {s["label"] for s in spans}
                    rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), 1.0 if spans else 0.5 if own else 0.0, spans))
                span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("mandatory", pa.int64())]))
                types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), span]
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, SCANNED)


def template_regex(markup: str) -> str:
    """A regular expression over words, each followed by one space, that accepts what the template accepts (for tests and SQL)."""
    out = []
    for token in _MARKUP.findall(markup):
        if token in ("[[", "(("):
            out.append("(?:")
        elif token in ("]]", "))"):
            out.append(")?" if token == "]]" else ")")
        elif token == "|":
            out.append("|")
        elif token.startswith("{{"):
            least, most = token[2:-2].split("..")
            out.append(f"(?:[^ ]+ ){{{least},{most}}}")
        else:
            out += [f"{w.decode()} " for w in words_of(token)]
    return "".join(out)
