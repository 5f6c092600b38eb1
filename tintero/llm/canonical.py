"""Problem 5: one consistent form for text that looks the same.

Method: quick-check properties are computed once for every assigned code point,
giving the set of *unstable* code points: those that change under the canonical
form (quick check "no") and those that may compose with what stands before them
(quick check "maybe": combining marks, conjoining Hangul vowels and finals, the
second parts of composed Indic vowels).  Per text, only runs of unstable code
points are isolated, widened to their boundary context (the letters and marks
around them), normalised and spliced back; the rest is copied unchanged.  On
tables, only texts with a code point that may be unstable enter Python.

Canonical form: NFC; width forms and Latin ligatures folded; every space
separator becomes U+0020; invisible format characters removed; the ordinal sign
U+00BA becomes U+00B0; look-alike Cyrillic and Greek letters become Latin unless
the word holds letters of that script that have no Latin twin (then the Latin
twins in the word become that script's letters).  Case, accents, digits,
superscripts, other punctuation and line breaks are kept.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintero.llm.arrow import flat_map

# Letters drawn alike in the Latin, Cyrillic and Greek scripts (Unicode confusables).
CYRILLIC = dict(zip("АВЕЅЗІЈКМНОРСТУХаеіјорсухѕһԁԛԝӏ", "ABES3IJKMHOPCTYXaeijopcyxshdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹνορϲ", "ABEZHIKMNOPTYXCvopc"))
LATIN_LIGATURES = range(0xFB00, 0xFB07)
CYRILLIC.pop("З", None)  # a letter, not a digit: digits show

LOOKALIKE = {**CYRILLIC, **GREEK}
_BACK = {"CYRILLIC": {b: a for a, b in reversed(CYRILLIC.items())}, "GREEK": {b: a for a, b in reversed(GREEK.items())}}


def _script(ch: str) -> str:
    cp = ord(ch)
    if 0x370 <= cp <= 0x3FF or 0x1F00 <= cp <= 0x1FFF:
        return "GREEK"
    if 0x400 <= cp <= 0x52F:
        return "CYRILLIC"
    return ""


def _invisible(ch: str) -> bool:
    """Format characters, variation selectors and fillers that draw nothing."""
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or ch in "͏ᅟᅠㅤﾠ"


def _fold(ch: str) -> str:
    """What a single code point becomes, before composition and look-alikes."""
    cp = ord(ch)
    if _invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch == "º":
        return "°"
    if ch == "\r":
        return "\r"
    if cp in LATIN_LIGATURES or 0xFF01 <= cp <= 0xFFEE:
        return unicodedata.normalize("NFKC", ch)
    return ch


#: Code points looked at: the planes with assigned characters (ideographs of the third plane included) and the tags.
_PLANES = (*range(0x80, 0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE1000))


@lru_cache(1)
def _maybe() -> frozenset[int]:
    """Code points that may compose with the one before (quick check "maybe"): second parts of composed characters, Hangul vowels and finals."""
    out = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for cp in _PLANES:
        ch = chr(cp)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.is_normalized("NFC", ch):
            out.add(int(parts[1], 16))
    return frozenset(out)


def _unstable(cp: int) -> bool:
    ch = chr(cp)
    return bool(cp in _maybe() or unicodedata.combining(ch) or _fold(ch) != ch or not unicodedata.is_normalized("NFC", ch) or _script(ch))


def _ranges(points) -> list[tuple[int, int]]:
    """Ascending code points as closed ranges."""
    out: list[list[int]] = []
    for cp in points:
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return [(a, b) for a, b in out]


@lru_cache(1)
def unstable_run() -> re.Pattern:
    """Pattern of runs of unstable code points, compiled from the properties above.

    Those above the basic plane are few and far between: all of them are looked at, as one range.
    """
    basic = [c for c in _PLANES if c < 0x10000 and _unstable(c)]
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in _ranges(basic)) + "\U00010000-\U000fffff]+")


_LETTERS = re.compile("(?:[^\\W_]|[\\u0300-\\u036f])+")


def _one_script(m: re.Match) -> str:
    """The letters of one word in one script."""
    word = "".join(LOOKALIKE.get(c, c) for c in m.group())
    # What is left of a script has no Latin twin: its word is in that script.
    left = {_script(c) for c in word} - {""}
    return "".join(_BACK[min(left)].get(c, c) for c in word) if left else word


@lru_cache(200_000)
def _segment(seg: str) -> str:
    """Canonical form of one segment with its boundary context."""
    out = unicodedata.normalize("NFD", "".join(map(_fold, seg)))
    out = _LETTERS.sub(_one_script, out)
    return unicodedata.normalize("NFC", out)


def _beside(ch: str) -> bool:
    """Letters, numbers and marks beside an unstable run are its boundary context."""
    return ch.isalnum() or unicodedata.category(ch)[0] == "M"


def canonical(text: str | None) -> str | None:
    """Canonical form of ``text``; null stays null, stable text is returned as it is."""
    if text is None or text.isascii():
        return text
    run = unstable_run()
    m = run.search(text)
    if m is None:
        return text
    out, done, n = [], 0, len(text)
    while m is not None:
        a, b = m.span()
        # A mark composes with whatever stands before it, letter or not.
        if a > done and (ord(text[a]) in _maybe() or unicodedata.combining(text[a])):
            a -= 1
        while a > done and _beside(text[a - 1]):
            a -= 1
        while b < n and _beside(text[b]):
            b += 1
        # A run inside the widened context belongs to the same segment.
        while (nxt := run.match(text, b)) is not None:
            b = nxt.end()
            while b < n and _beside(text[b]):
                b += 1
        out.append(text[done:a])
        out.append(_words(text[a:b]))
        done = b
        m = run.search(text, b)
    out.append(text[done:])
    return "".join(out)


_SPACE = re.compile(r"([\s  -   　]+)")


def _words(seg: str) -> str:
    """Segments are normalised word by word, so that one word's script does not decide another's."""
    return "".join(_segment(w) for w in _SPACE.split(seg)) if len(seg) < 400 else "".join(_segment(w) if len(w) < 400 else _segment.__wrapped__(w) for w in _SPACE.split(seg))


@lru_cache(1)
def _unusual() -> str:
    """Java pattern: a code point that is not among the stable ones of the usual blocks.

    The first class lets the plainest text pass at once; only what it stops at is looked up in the long one.
    """
    usual = [c for c in _PLANES if (c < 0x250 or 0x2010 <= c < 0x2800 or 0x3041 <= c < 0x3100 or 0x4E00 <= c < 0xA000) and not _unstable(c)]
    listed = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges(usual))
    return rf"[^\x{{0}}-\x{{9f}}](?<![{listed}])"


def with_canonical(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` with the canonical form of a text column.

    Texts of stable code points only stay in the JVM as they are; the others
    enter Python.  Null stays null; no column of ``df`` may be called ``out_col``.
    """
    text = F.col(text_col)
    hard = F.coalesce(text.rlike(_unusual()), F.lit(False))
    at = df.columns.index(text_col)

    def run(rows):
        for row in rows:
            yield *row, canonical(row[at])

    easy = df.where(~hard).withColumn(out_col, text)
    return easy.unionByName(flat_map(df.where(hard), run, easy.schema))
