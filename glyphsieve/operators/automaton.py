"""Rules by one Aho-Corasick scan of each variant, in Arrow batches: cost follows texts and hits, not the number of rules."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from operator import itemgetter

from glyphsieve import tables
from glyphsieve.flags import ProcessType
from glyphsieve.plans.compiler import Compiled
from glyphsieve.plans.naive import word_character

_SECOND = itemgetter(1)

try:
    import ahocorasick
except ModuleNotFoundError:  # optional: a slower scan takes its place
    ahocorasick = None


def _each(entry: int | list[tuple[bool, bool, int, int]]) -> Sequence[tuple[bool, bool, int, int]]:
    return ((False, False, entry, 0),) if entry.__class__ is int else entry


class Scanner:
    """Compiled rules ready to scan; can be pickled, so it is broadcast once."""

    def __init__(self, compiled: Compiled):
        simple = [(False, 1)]
        self.rules = [(word_id, word, 1 if p is not None else len(compiled.parsed[k].needed)) for k, ((_, word_id, word), p) in enumerate(zip(compiled.rows, compiled.literals, strict=True))]
        self.process_types = [r[0] for r in compiled.rows]
        self.segments = [simple if p is not None else [(s.negative, s.quota) for s in compiled.parsed[k].segments] for k, p in enumerate(compiled.literals)]
        # a rule of one needed segment that one hit fulfils fires at once
        self.simple = [s is simple or (len(s) == 1 and s[0] == (False, 1)) for s in self.segments]
        by_type: dict[int, dict[str, int | list[tuple[bool, bool, int, int]]]] = {pt: {} for pt in compiled.types()}
        for k, p in enumerate(compiled.literals):
            if p:
                own = by_type[self.process_types[k]]
                if own.setdefault(p, k) != k:  # several rules of one pattern
                    own[p] = [*_each(own[p]), (False, False, k, 0)]
        for k, rule in compiled.parsed.items():
            own = by_type[self.process_types[k]]
            for s in rule.segments:
                for a in s.alternatives:
                    left, right = a.left and word_character(a.pattern[0]), a.right and word_character(a.pattern[-1])
                    own[a.pattern] = [*(_each(own[a.pattern]) if a.pattern in own else ()), (left, right, k, s.number)]
        by_type = {pt: own for pt, own in by_type.items() if own}
        self.tables = {int(s): tables.table(s, compiled.own) for pt in by_type for s in ProcessType(pt).steps()}
        self.owned = set(compiled.own or ())
        #: Of each pattern the number of its one simple rule, else (left, right, rule, segment) of each of its places.
        self.entries = {pt: list(patterns.values()) for pt, patterns in by_type.items()}
        self.lengths = {pt: [len(p) for p in patterns] for pt, patterns in by_type.items()}
        self.direct = {pt: [e.__class__ is int or all(self.simple[r] and not left and not right for left, right, r, _ in e) for e in entries] for pt, entries in self.entries.items()}
        self.all_direct = {pt: all(d) for pt, d in self.direct.items()}
        self.only_rule = {pt: [e if e.__class__ is int else e[0][2] if len(e) == 1 else -1 for e in entries] for pt, entries in self.entries.items()}
        self.automata = {}
        for pt, patterns in by_type.items():
            if ahocorasick:
                self.automata[pt] = ahocorasick.Automaton()
                for k, p in enumerate(patterns):
                    self.automata[pt].add_word(p, k)
                self.automata[pt].make_automaton()
            else:
                self.automata[pt] = list(patterns)

    def _scan(self, pt: int, text: str):  # noqa: ANN202
        automaton = self.automata[pt]
        if ahocorasick:
            return automaton.iter(text)
        return ((at + len(p) - 1, k) for k, p in enumerate(automaton) for at in range(len(text)) if text.startswith(p, at))

    def _variants(self, pt: int, text: str) -> list[str]:
        steps = ProcessType(pt).steps()
        out = [text] if not steps or steps[0] == ProcessType.DELETE else []
        plain = text.isascii()
        for s in steps:
            if plain and s != ProcessType.DELETE and int(s) not in self.owned:
                text = text.lower() if s == ProcessType.NORMALIZE else text
            else:
                text = text.translate(self.tables[int(s)])
            out.append(text)
        return list(dict.fromkeys(out))

    def fired(self, text: str | None, first: bool = False, least: bool = False) -> list[int]:
        """Numbers of the rules that fire, ascending; with first, one of them as soon as it is sure; with least, those of the first
        process type that has any, as rules are numbered by type: types behind it are not scanned."""
        if not text:
            return []
        done: set[int] = set()
        best: dict[tuple[int, int], int] = {}
        for pt, entries in sorted(self.entries.items()):
            direct, lengths = self.direct[pt], self.lengths[pt]
            for form in self._variants(pt, text):
                if self.all_direct[pt]:  # single literals: which are found is all that counts
                    hits = self._scan(pt, form)
                    if first:
                        hit = next(hits, None)
                        if hit is not None:
                            return [_each(entries[hit[1]])[0][2]]
                        continue
                    only = self.only_rule[pt]
                    for k in set(map(_SECOND, hits)):
                        if only[k] >= 0:
                            done.add(only[k])
                        else:
                            done.update(r for _, _, r, _ in _each(entries[k]))
                    continue
                sums: dict[tuple[int, int], int] = defaultdict(int)
                seen: set[int] = set()
                for end, k in self._scan(pt, form):
                    if direct[k]:
                        if k not in seen:
                            seen.add(k)
                            done.update(r for _, _, r, _ in _each(entries[k]))
                            if first:
                                return [min(done)]
                        continue
                    start = end + 1 - lengths[k]
                    for left, right, rule, segment in entries[k]:
                        if left and start and word_character(form[start - 1]):
                            continue
                        if right and end + 1 < len(form) and word_character(form[end + 1]):
                            continue
                        if self.simple[rule]:
                            done.add(rule)
                            if first:
                                return [rule]
                        else:
                            sums[rule, segment] += 1
                for at, n in sums.items():
                    if n > best.get(at, 0):
                        best[at] = n
            if least:
                done.update(self.settled(best))
                if done:
                    return sorted(done)
        done.update(self.settled(best))
        return sorted(done)

    def hits(self, text: str | None) -> dict[tuple[int, int], int]:
        """Hits of each segment, by rule and segment: the most of any variant of the text; none of a null or empty text."""
        best: dict[tuple[int, int], int] = {}
        for pt, entries in self.entries.items() if text else ():
            for form in self._variants(pt, text):
                sums: dict[tuple[int, int], int] = defaultdict(int)
                for end, k in self._scan(pt, form):
                    start = end + 1 - self.lengths[pt][k]
                    for left, right, rule, segment in _each(entries[k]):
                        cut_left = left and start and word_character(form[start - 1])
                        cut_right = right and end + 1 < len(form) and word_character(form[end + 1])
                        if not cut_left and not cut_right:
                            sums[rule, segment] += 1
                for at, n in sums.items():
                    best[at] = max(n, best.get(at, 0))
        return best

    def settled(self, best: dict[tuple[int, int], int]) -> list[int]:
        """The rules whose needed segments all have their quota and whose vetoing ones have not."""
        have: dict[int, int] = defaultdict(int)
        for (rule, segment), n in best.items():
            negative, quota = self.segments[rule][segment]
            if n >= quota:
                have[rule] += -1_000_000 if negative else 1
        return [r for r, n in have.items() if n == self.rules[r][2]]

    def is_match(self, text: str | None) -> bool:
        return bool(self.fired(text, first=True))

    def any_fired(self, texts: list[str | None]) -> list[bool]:
        """is_match of many texts. Where all rules are literals of one type without transforms, a text is scanned to its first hit and no further."""
        if len(self.entries) == 1 and ahocorasick and self.all_direct.get(1):
            scan, none = self.automata[1].iter, (None,)
            return [bool(t) and next(scan(t), none)[0] is not None for t in texts]
        return [self.is_match(t) for t in texts]

    def process(self, text: str | None) -> list[dict]:
        return [{"word_id": self.rules[r][0], "word": self.rules[r][1]} for r in self.fired(text)]
