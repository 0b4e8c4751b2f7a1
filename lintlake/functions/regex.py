"""Pattern dialects: the catalogue is written for Python's ``re``; Spark runs java.util.regex."""

from __future__ import annotations

import re

# Python's str patterns use Unicode character classes. These spell them out, so that every engine
# (Java here, RE2 in the check) means the same characters.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Characters Python's str.strip() removes and the line ends str.splitlines() honours.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
RARE_LINE_END = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# "." also matches line ends (s); "^$" are per line (m); only \n is a line end (d). Case folding stays ASCII.
DOTALL = "(?msd)"
LINEWISE = "(?imd)"


def _classes(pattern: str) -> str:
    return pattern.replace(r"\w", WORD).replace(r"\s", SPACE)


def java(pattern: str) -> str:
    """The body of a pattern for Java. ``[^}]+}`` and the like become possessive: same matches, no re-tries."""
    body = _classes(pattern).replace(r"\b", BOUNDARY)
    return body.replace(r"[^}]+\}", r"[^}]++\}").replace(r"[^)]*\)", r"[^)]*+\)")


def folded(pattern: str) -> str:
    """A case-insensitive pattern for text that is in lower case already: Java matches plain letters much
    faster than with ``(?i)``. (The catalogue uses no escapes whose meaning depends on case.)"""
    return java(pattern.removeprefix("(?i)").lower())


def leading_literal(pattern: str) -> str:
    """The plain text a pattern starts with."""
    plain = re.match(r"(?:[^\\.^$*+?{}\[\]|()]|\\[^\w])*", pattern).group()
    follow = pattern[len(plain):len(plain) + 1]
    if follow in ("*", "?", "{"):  # the last character may be absent
        plain = plain[:-2] if plain[-2:-1] == "\\" else plain[:-1]
    return re.sub(r"\\(.)", r"\1", plain)


def re2(pattern: str) -> str:
    """The body of a pattern for RE2 (used by the SQL checks only)."""
    return _classes(pattern)
