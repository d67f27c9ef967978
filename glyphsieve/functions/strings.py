"""The transforms of single Python strings, for rules, tests and small jobs."""

from __future__ import annotations

from glyphsieve import tables
from glyphsieve.flags import ProcessType
from glyphsieve.functions.transforms import steps_of
from glyphsieve.tables import Own


def process_text(pt: int, text: str, own: Own = None) -> str:
    """The text after all transforms of pt."""
    for step in steps_of(pt):
        text = tables.translate(step, text, own)
    return text


def reduce_text(pt: int, text: str, own: Own = None) -> list[str]:
    """The text and each transform's result that differs from the one before."""
    out = [text]
    for step in steps_of(pt):
        text = tables.translate(step, text, own)
        if text != out[-1]:
            out.append(text)
    return out


def reduce_text_emit(pt: int, text: str, own: Own = None) -> list[str]:
    """As reduce_text, but a changed result takes the place of the last entry, except that Delete's adds one."""
    out = [text]
    for step in steps_of(pt):
        text = tables.translate(step, text, own)
        if text != out[-1]:
            out[(len(out) if step == ProcessType.DELETE else -1) :] = [text]
    return out
