"""Text forms shared by the operators: words, canonical content."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

#: A word: an unbroken run of letters and digits.
WORD = re.compile(r"[^\W_]+")
_FIELD = re.compile(r"\s*([^\W\d]\w*(?:[.-]\w+)*)\s*:\s*(.*?)\s*", re.S)
_BREAKS = (re.compile(r"[\r\n]+"), re.compile(r"\|"), re.compile(r";"))


def nfc(text: str) -> str:
    """``text`` with its accents composed."""
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def words(text: str) -> list[str]:
    """The words of ``text`` in lower case, after composing accents."""
    return WORD.findall(nfc(nfc(text).lower()))


def letters(text: str) -> str:
    """Only the letters and digits of ``text``, in lower case, accents composed."""
    return "".join(words(text))


def _flat(value: object, at: str, out: set[tuple[str, str]]) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _flat(v, f"{at}/{letters(str(k))}" if at else letters(str(k)), out)
        if not value:
            out.add((at, ""))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _flat(v, f"{at}/{i}", out)
        if not value:
            out.add((at, ""))
    else:
        out.add((at, letters(value if isinstance(value, str) else "null" if value is None else str(value).lower())))


def fields(text: str) -> set[tuple[str, str]] | None:
    """The (key, value) pairs of a record, each in letters and digits only; None where ``text`` is no record.

    A record is a JSON object, or at least three ``key: value`` fields set apart by line breaks, ``|`` or ``;``,
    with nothing but fields between the breaks, each key one name and used once.  Numbers keep their spelling.
    """
    bare = text.strip(" \t\r\n﻿​ ")
    if bare[:1] == "{" and bare[-1:] == "}":
        try:
            value = json.loads(bare, parse_float=str, parse_int=str)
        except (ValueError, RecursionError):
            value = None
        if isinstance(value, dict):
            out: set[tuple[str, str]] = set()
            _flat(value, "", out)
            return out
    if bare.count(":") < 3:
        return None
    for breaks in _BREAKS:
        parts = [p for p in breaks.split(bare) if p.strip()]
        if len(parts) >= 3:
            found = [_FIELD.fullmatch(p) for p in parts]
            if all(found) and len({letters(m[1]) for m in found}) == len(found):
                return {(letters(m[1]), letters(m[2])) for m in found}
    return None


def canonical(text: str) -> str:
    """One text for all formats of a content: sorted fields of a record, else its letters and digits."""
    f = fields(text)
    if f is None:
        return letters(text)
    return "\x1e".join(sorted(f"{k}\x1f{v}" for k, v in f)) + "\x1d"


def digest(text: str) -> bytes:
    """SHA-256 of the UTF-8 text; lone surrogates are kept apart."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
