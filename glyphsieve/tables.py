"""Codepoint tables behind the transforms, each derived from a rule over the Unicode database or ICU.

A table maps a codepoint to its replacement; None deletes. Rules need Python's unicodedata, and for Han variants, Han
readings and look-alike letters the ICU library in Spark's JVM, which is asked once for each table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping
from fractions import Fraction
from functools import cache
from pathlib import Path

Table = dict[int, str | None]
#: Tables that take the place of derived ones, by transform bit.
Own = Mapping[int, Table] | None
#: General categories whose characters Delete drops.
DELETED = ("Cc", "Cf", "Mc", "Me", "Mn", "Pc", "Pd", "Pe", "Pf", "Pi", "Po", "Ps", "Sc", "Sk", "Sm", "So", "Zl", "Zp", "Zs")
#: Syllable parts of the Revised Romanization of Korean.
KOREAN_INITIAL = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
KOREAN_MEDIAL = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
KOREAN_FINAL = ("", "g", "kk", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss", "ng", "j", "ch", "k", "t", "p", "h")
#: Kana whose Hepburn reading is not the last word of their Unicode name.
HEPBURN = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji"}


def _characters() -> Iterable[str]:
    return (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def _mark(c: str) -> bool:
    return unicodedata.category(c) in ("Mn", "Mc", "Me")


def _icu(convert: Callable[[object, str], str], characters: list[str]) -> dict[str, str]:
    """convert of each character; all are sent to the JVM as the lines of one string."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.builder.getOrCreate()._jvm
    return dict(zip(characters, convert(jvm, "\n".join(characters)).split("\n"), strict=True))


def _transliterated(name: str, characters: list[str]) -> dict[str, str]:
    return _icu(lambda jvm, text: jvm.com.ibm.icu.text.Transliterator.getInstance(name).transliterate(text), characters)


@cache
def delete() -> Table:
    return {ord(c): None for c in _characters() if unicodedata.category(c) in DELETED}


@cache
def numbers() -> Table:
    """Numeric characters as integers, fractions with a denominator up to 1000, or decimals."""
    out: Table = {}
    for c in _characters():
        value = unicodedata.numeric(c, None)
        if value is None:
            continue
        if value.is_integer() if isinstance(value, float) else True:
            text = str(int(value))
        else:
            near = Fraction(value).limit_denominator(1000)
            text = f"{near.numerator}/{near.denominator}" if abs(float(near) - value) < 1e-9 else f"{value:.15g}"
        if text != c:
            out[ord(c)] = text
    return out


@cache
def look_alikes() -> Table:
    """Letters beyond ASCII whose skeleton, by ICU's confusables, is ASCII letters once marks are dropped."""
    letters = [c for c in _characters() if ord(c) > 127 and unicodedata.category(c)[0] in "LNSP"]
    skeletons = _icu(lambda jvm, text: jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton(0, text), letters)
    out: Table = {}
    for c, s in skeletons.items():
        s = "".join(x for x in unicodedata.normalize("NFD", s) if not _mark(x))
        if s.isascii() and s.isalpha():
            out[ord(c)] = s.lower()
    return out


@cache
def normalize() -> Table:
    """Numbers; else compatibility forms without marks, case-folded; else look-alikes. A bare mark maps to nothing new and stays."""
    out = dict(numbers())
    for c in _characters():
        if ord(c) in out:
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not _mark(x))
        folded = unicodedata.normalize("NFKC", bare).casefold()
        if folded and folded != c:
            out[ord(c)] = folded
    for c, s in look_alikes().items():
        if c not in numbers() and not (out.get(c) or "é").isascii():
            out[c] = s
    return out


@cache
def variant_norm() -> Table:
    """Traditional to simplified Han by ICU, half-width to full-width katakana by compatibility; one character to one."""
    han = [c for c in _characters() if unicodedata.name(c, "").startswith("CJK UNIFIED") or unicodedata.name(c, "").startswith("CJK COMPAT")]
    out: Table = {ord(c): s for c, s in _transliterated("Traditional-Simplified", han).items() if len(s) == 1 and s != c}
    for c in map(chr, range(0xFF66, 0xFF9E)):
        out[ord(c)] = unicodedata.normalize("NFKC", c)
    return out


@cache
def readings() -> Table:
    """Syllables: Han by ICU's Han-Latin without tones, kana in Hepburn by their names, Hangul by its parts."""
    han = [c for c in _characters() if unicodedata.name(c, "").startswith("CJK UNIFIED") or c == "〇"]
    out: Table = {}
    for c, s in _transliterated("Han-Latin", han).items():
        s = "".join(x for x in unicodedata.normalize("NFD", s) if not _mark(x)).lower().strip()
        if s and s.isascii() and s != c:
            out[ord(c)] = s.split()[0]
    for c in map(chr, [*range(0x3041, 0x3097), *range(0x30A1, 0x30FB)]):
        word = unicodedata.name(c).split()[-1].lower()
        out[ord(c)] = HEPBURN.get(word, word)
    for k in range(len(KOREAN_INITIAL) * 21 * 28):
        out[0xAC00 + k] = KOREAN_INITIAL[k // 588] + KOREAN_MEDIAL[k % 588 // 28] + KOREAN_FINAL[k % 28]
    return out


@cache
def romanize() -> Table:
    return {c: f" {s}" for c, s in readings().items()}


def read_names(path: str | Path) -> Table:
    """A table of names for transform bit 64, from a file of lines "character<TAB>name": a space and the name stand for the character, which is
    dropped where the line has no name. # starts a comment, of equal characters the last stays. A file that is not there is an error, as is a key
    that is no single character."""
    out: Table = {}
    for line in Path(path).read_text(encoding="utf-8").split("\n"):
        if line and line[0] != "#":
            key, _, name = line.partition("\t")
            if len(key) != 1:
                raise ValueError(f"{path}: {key!r} is no single character")
            out[ord(key)] = f" {'_'.join(name.split())}" if name.strip() else None
    return out


@cache
def _pictographs() -> list[str]:
    """Other symbols with ICU's emoji property, the sound recording sign among them though it has none."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.builder.getOrCreate()._jvm
    found = jvm.java.util.ArrayList()
    jvm.com.ibm.icu.text.UnicodeSet("[[:Emoji:]&[:So:]&[\\u0200-\\U0010FFFF]]").addAllTo(found)
    return [*jvm.java.lang.String.join("", found), "\u2117"]


@cache
def emoji() -> Table:
    """A space and the Unicode name of each pictograph, without "sign" or "symbol" at its end, in lower case and with _ for spaces; joiners, variation
    selectors and skin tones are dropped; regional indicators are a space and their letter. Common short names differ for many (the red
    heart is a heavy black heart here): read_names takes them from a file."""
    names = {c: unicodedata.name(c, "").lower().removesuffix(" sign").removesuffix(" symbol") for c in _pictographs()}
    out: Table = {ord(c): f" {'_'.join(n.split())}" for c, n in names.items() if n}
    out |= {c: None for c in (0x200D, 0xFE0E, 0xFE0F, *range(0x1F3FB, 0x1F400))}
    return out | {0x1F1E6 + k: f" {chr(97 + k)}" for k in range(26)}


def table(step: int, own: Own = None) -> Table:
    """The table of one transform bit: own's, if own has one, else the derived one."""
    if own and int(step) in own:
        return own[int(step)]
    return {2: variant_norm, 4: delete, 8: normalize, 16: romanize, 32: readings, 64: emoji}[int(step)]()


def translate(step: int, text: str, own: Own = None) -> str:
    """One transform of a text, in Python."""
    if not (own and int(step) in own):
        if int(step) == 8 and text.isascii():
            return text.lower()
        if int(step) in (2, 16, 32, 64) and text.isascii():
            return text
    return text.translate(table(step, own))


def composed(steps: Iterable[int], own: Own = None) -> Table:
    """One table that does what steps do one after another: each maps single characters, so all of them together do."""
    every = [table(s, own) for s in steps]
    out: Table = {}
    for c in set().union(*every):
        text = chr(c)
        for t in every:
            text = text.translate(t)
        if text != chr(c):
            out[c] = text or None
    return out
