"""Shell patterns over paths: ``*``, ``?``, ``[...]`` and ``[!...]``, as one regular expression.

A pattern covers the whole path and ``*`` crosses directories, as lists of files to leave out have it. All patterns of a list
become one alternation, so a path is looked at once however many there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that a table of them may hold; they are compiled on the driver.
MAX_PATTERNS = 10_000

_NOTHING = r"(?!)"


def _literal(char: str) -> str:
    return char if char.isascii() and (char.isalnum() or char == "/") else rf"\x{{{ord(char):x}}}"


def _set(body: str) -> str:
    """What stands between the brackets of a set, as a class of code points."""
    negated, chars = body[:1] == "!", body[1:] if body[:1] == "!" else body
    parts, i = [], 0
    while i < len(chars):
        if i + 2 < len(chars) and chars[i + 1] == "-":
            if chars[i] <= chars[i + 2]:  # a range that runs backwards is empty
                parts.append(rf"\x{{{ord(chars[i]):x}}}-\x{{{ord(chars[i + 2]):x}}}")
            i += 3
        else:
            parts.append(rf"\x{{{ord(chars[i]):x}}}")
            i += 1
    if not parts:
        return "." if negated else _NOTHING
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def _tokens(pattern: str) -> Iterable[str]:
    """The expression of each part of a pattern; a run of stars is one ``*``."""
    i, last = 0, ""
    while i < len(pattern):
        char, i = pattern[i], i + 1
        if char == "*":
            if last != "*":
                yield "*"
        elif char == "?":
            yield "."
        elif char == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) >= 0:
            yield _set(pattern[i:end])
            i = end + 1
        else:  # also a bracket that is never closed
            yield _literal(char)
        last = char


def glob_regex(pattern: str) -> str:
    """A regular expression for the whole path.

    What follows a star is sought once and then kept (an atomic group): the first place it fits at is
    never worse than a later one, so many stars do not multiply the work.
    """
    parts: list[list[str]] = [[]]
    for token in _tokens(pattern):
        if token == "*":
            parts.append([])
        else:
            parts[-1].append(token)
    fixed = ["".join(p) for p in parts]
    if len(fixed) == 1:
        return fixed[0]
    middle = "".join(f"(?>.*?{p})" for p in fixed[1:-1])
    return f"{fixed[0]}{middle}.*{fixed[-1]}"


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns covers the path. Null paths match nothing, and so does an empty list.

    Plain beginnings (``dir/*``) and endings (``*.bin``) are compared as such; all others are one alternation.
    """
    hit, others = F.lit(False), []
    for pattern in dict.fromkeys(patterns):
        text = pattern.strip("*")
        if any(c in text for c in "*?[") or (pattern[:1] == pattern[-1:] == "*"):
            others.append(f"(?:{glob_regex(pattern)})")
        elif pattern.endswith("*"):
            hit = hit | F.startswith(path, F.lit(text))
        elif pattern.startswith("*"):
            hit = hit | F.endswith(path, F.lit(text))
        else:
            hit = hit | (path == text)
    if others:
        hit = hit | path.rlike(rf"(?s)\A(?:{'|'.join(others)})\z")
    return F.coalesce(hit, F.lit(False))


def table_patterns(table: DataFrame, column: str = "pattern") -> list[str]:
    """The distinct patterns of a table, nulls aside; more than ``MAX_PATTERNS`` are an error."""
    found = table.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    return sorted(row[0] for row in found)
