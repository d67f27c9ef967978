"""A rule interpreter for one text, written for clarity: what every plan must agree with."""

from __future__ import annotations

from glyphsieve import tables
from glyphsieve.flags import ProcessType
from glyphsieve.plans.compiler import Alternative, Compiled, Rule
from glyphsieve.tables import Own


def word_character(c: str) -> bool:
    """ASCII letters, digits, underscore, and everything beyond ASCII."""
    return ord(c) > 127 or c == "_" or c.isalnum()


def hits(text: str, a: Alternative) -> int:
    """Occurrences, overlaps included, whose marked ends don't cut a word."""
    n, at = 0, text.find(a.pattern)
    while at >= 0:
        end = at + len(a.pattern)
        cut_left = a.left and at > 0 and word_character(text[at - 1]) and word_character(a.pattern[0])
        cut_right = a.right and end < len(text) and word_character(text[end]) and word_character(a.pattern[-1])
        n += not (cut_left or cut_right)
        at = text.find(a.pattern, at + 1)
    return n


def text_variants(pt: ProcessType, text: str, own: Own = None) -> list[str]:
    steps = pt.steps()
    out = [text] if not steps or steps[0] == ProcessType.DELETE else []
    for s in steps:
        text = tables.translate(s, text, own)
        out.append(text)
    return list(dict.fromkeys(out))


def fires(rule: Rule, text: str, own: Own = None) -> bool:
    forms = text_variants(rule.process_type, text, own)
    for s in rule.segments:
        most = max(sum(hits(v, a) for a in s.alternatives) for v in forms)
        if (most >= s.quota) == s.negative:
            return False
    return True


def process(compiled: Compiled, text: str | None) -> list[tuple[int, str]]:
    """(word_id, word) of the rules that fire, by process type and id."""
    return [(r.word_id, r.word) for r in compiled.rules if text and fires(r, text, compiled.own)]
