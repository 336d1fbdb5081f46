"""The normalised form of a string and its look-up forms in plain Python, for tasks that have texts at hand.

The same as text.normalize() and text.lookups(), which work on columns; a test compares them.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .text import DASH_CLASS, GREEK, GREEK_LATIN, ROMAN, TRANSLITERATION

#: Capitals of Unicode 16, which Java may know before Python does.
_LATE = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)}
_TABLE = str.maketrans(TRANSLITERATION) | _LATE
_DASH = re.compile("[" + re.sub(r"\\x\{(\w+)\}", r"\\u\1", DASH_CLASS)[1:])
#: White space as Unicode has it; Python counts four control characters more.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_GREEK_NAME = re.compile("|".join(sorted({*GREEK.values(), *GREEK_LATIN}, key=len, reverse=True)))
_GREEK_LETTER = re.compile("[\u0370-\u03ff]")
_NUMERAL = re.compile(r".*[- ]([0-9]+|[IXVixv]+)\Z")
_OTHER = {a: b for i, r in enumerate(ROMAN, 1) for a, b in ((r, str(i)), (str(i), r))}
_LETTERS = re.compile(r"[A-Za-z]+\Z")


def normalized(s: str) -> str:
    """White space, then dashes (removed), then ASCII spellings, then lower case; not trimmed."""
    if s.isascii() and s.isprintable():
        s = _SPACE.sub(" ", s) if "  " in s else s
        return s.replace("-", "").lower()
    return _DASH.sub("", _SPACE.sub(" ", s)).translate(_TABLE).lower()


@lru_cache(1 << 16)
def _greek(word: str) -> tuple[str, str]:
    """Names of Greek letters as letters, and as Latin letters, one name after the other; no name has a space."""
    uni = latin = word
    if _GREEK_NAME.search(word):
        for letter, name in GREEK.items():
            uni = uni.replace(name, letter)
        for name, letter in GREEK_LATIN.items():
            latin = latin.replace(name, letter)
    return uni, latin


def is_odd(token: str) -> bool:
    """Whether a string of which this is a token may have more forms than its lower case."""
    return not _LETTERS.match(token) or _GREEK_NAME.search(token) is not None


def is_odd_last(token: str) -> bool:
    """The same for a last token."""
    return token.endswith("s") or token.upper() in _OTHER


def lookups(raw: str) -> set[str]:
    """The normalised variants under which a string is looked up."""
    plain = raw.isascii()
    out = {raw, raw.replace("-", " ") if plain else _DASH.sub(" ", raw)}
    out.update(map(" ".join, zip(*map(_greek, raw.split(" ")), strict=True)))
    if not plain and _GREEK_LETTER.search(raw):
        out.add("".join(GREEK.get(c, c) for c in raw))
    if (m := _NUMERAL.match(raw)) and (other := _OTHER.get(m[1].upper())):
        out.add(raw[: m.start(1)] + other)
    if raw.endswith("s") and not raw.endswith("sis"):
        out.add(raw[:-1])
        if raw.endswith(("oes", "xes", "ses", "ches", "shes")):
            out.add(raw[:-2])
        elif raw.endswith("ies"):
            out.add(raw[:-3] + "y")
    return {normalized(x) for x in out}
