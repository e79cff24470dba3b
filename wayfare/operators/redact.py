"""Redaction of personal data, in a fixed order of rules, as native replacements."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import bound
from ..functions.udf import on_arrow

#: A token of six capitals and digits with both, by where the first change between them is.
_SIX = "|".join(f"[A-Z]{{{k}}}[0-9][A-Z0-9]{{{5 - k}}}|[0-9]{{{k}}}[A-Z][A-Z0-9]{{{5 - k}}}" for k in range(1, 6))

# -- fixed values: (pattern, replacement, what every match holds or ""), applied in order, without look-around -----
RULES = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "someone@example.com", "@"),
    (r"[A-Za-z][A-Za-z0-9_.'-]*(?: +[A-Za-z][A-Za-z0-9_.'-]*){0,3} *<someone@example\.com>", "Traveller <someone@example.com>", "<someone@"),
    (r"\b[A-Za-z]\*[Xx*]{4,}[A-Za-z]*", "someone@example.com", "*"),
    (r"(?i)\b(user ?(?:id|name)|login)( *[:=] *)[A-Za-z0-9_.@-]+", "$1$2traveller", ""),
    (r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]{3}\b", "00AAAAA0000A0Z0", ""),
    (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "AAAAA0000A", ""),
    (r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b", "0000 0000 0000 0000", ""),
    (r"\+[0-9]{1,3}[ -]?[0-9][0-9 -]{7,12}[0-9]", "+00 0000000000", "+"),
    (r"\b[0-9]{2,}X{3,}[0-9]{2,}\b", "0000000000", "XXX"),
    (r"\b[0-9]{11,}\b", "00000000000", ""),
    (r"\b[0-9]{10}\b", "0000000000", ""),
    (r"\b([A-Z]{2,3})[0-9]{8,18}\b", "${1}00000000", ""),
    (r"\b(PNR|Ref|Booking)(\s*[:#]?\s*)[A-Z0-9]{6}\b", "$1$2XXXXXX", ""),
    (rf"\b(?:{_SIX})\b", "XXXXXX", ""),
    (r"\b[0-9]+[/-][0-9]+[^,\n]*, *(?:WARD|Ward|F NO|FLAT|Flat|DOOR|Door|H NO|PLOT|Plot)\b[^|\n]*", "1/1 Sample street", ","),
    (r"\b(?:WARD|Ward) *No\.? *[0-9]+", "Ward No. 1", "No"),
]
# ----------------------------------------------------------------------------------------------------------------


def redact(text: Column) -> Column:
    """All rules over a text; a rule whose matches hold a fixed string is only tried where that stands."""
    for rule in RULES:
        text = _applied(text, *rule)
    return text


def _applied(text: Column, pattern: str, replacement: str, needs: str) -> Column:
    swap = replacement.replace("${1}0", "$1\\0")  # a digit that is no group's number
    if not needs:
        return F.regexp_replace(text, pattern, swap)
    return bound(text, lambda t: F.when(t.contains(needs), F.regexp_replace(t, pattern, swap)).otherwise(t))


_NAME = re.compile(r"(?i)\b(?:mr|mrs|ms|miss|dr|dear|passenger(?: name)?|guest(?: name)?)\b\.?\s*:?\s*((?:[A-Z][\w'-]+\s?){1,4})")


def redact_page(texts: list[str]) -> list[str]:
    """The texts of a page with names found by title, greeting or label replaced alike everywhere, and ten-digit numbers by order of appearance."""
    names: dict[str, str] = {}
    for t in texts:
        for m in _NAME.finditer(t):
            for word in m[1].split():
                if len(word) > 2 and word.lower() not in ("name", "passenger", "guest", "dear"):
                    names.setdefault(word.lower(), f"NAME{len(names) + 1}")
    numbers: dict[str, str] = {}
    out = []
    for t in texts:
        t = re.sub(r"\b\d{10}\b", lambda m: numbers.setdefault(m[0], f"{len(numbers) + 1:010d}"), t)
        for pattern, replacement, _ in RULES:
            if pattern != r"\b[0-9]{10}\b":
                t = re.sub(pattern, re.sub(r"\$\{?(\d)\}?", r"\\g<\1>", replacement), t)
        for word, stand_in in names.items():  # last, as stand-ins look like references
            t = re.sub(rf"(?i)\b{re.escape(word)}\b", stand_in, t)
        out.append(t)
    return out


@on_arrow("array<string>")
def redact_pages(texts):
    return redact_page(texts) if texts is not None else None
