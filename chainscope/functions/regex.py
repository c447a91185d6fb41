"""Regex dialect helpers for catalogue patterns.

Catalogue patterns are authored in the JavaScript dialect.  Spark runs
``java.util.regex``; the DuckDB oracle runs RE2.  The differences that
matter for the catalogues:

* ``\\b`` is an ASCII word boundary in JavaScript (no ``u`` flag) and in
  RE2, but Unicode-aware in Java.  For Spark it is rewritten as an explicit
  ASCII boundary built from look-arounds.
* the ``i`` flag becomes an inline ``(?i)`` (ASCII folding in Java).
* RE2 has no look-around and no back-references; the oracle states the
  rules that use them in parts (``plans.sql.SPLIT_RULES``).
"""

from __future__ import annotations

_WORD = "[A-Za-z0-9_]"
ASCII_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _tokens(pattern: str):
    """Yield (token, in_class) pairs; escapes stay glued to their char."""
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            yield pattern[i:i + 2], in_class
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        yield ch, in_class
        i += 1


def to_java(pattern: str, flags: str = "") -> str:
    out = []
    for tok, in_class in _tokens(pattern):
        out.append(ASCII_BOUNDARY if tok == "\\b" and not in_class else tok)
    body = "".join(out)
    return ("(?i)" + body) if "i" in flags else body


def to_re2(pattern: str, flags: str = "") -> str:
    return ("(?i)" + pattern) if "i" in flags else pattern


def re2_compatible(pattern: str) -> bool:
    """False when the pattern needs look-around or back-references."""
    for tok, in_class in _tokens(pattern):
        if in_class:
            continue
        if tok in ("(?=", "(?!") or (len(tok) == 2 and tok[0] == "\\" and tok[1].isdigit() and tok[1] != "0"):
            return False
    return "(?=" not in pattern and "(?!" not in pattern and "(?<" not in pattern


def sql_str(s: str) -> str:
    """A standard-SQL string literal (no backslash escapes): DuckDB form."""
    return "'" + s.replace("'", "''") + "'"
