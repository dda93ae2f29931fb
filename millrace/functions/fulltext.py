"""Full-text search in boolean mode over the set of a text's words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import EngineError
from millrace.lexer import quote

LEAST_LENGTH = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Different runs of ASCII letters and digits of three or more, lower-cased in ASCII alone."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= LEAST_LENGTH))


def tokens_sql(text: str) -> str:
    return f"array_distinct(filter(split(translate(coalesce(CAST({text} AS STRING), ''), '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+'), x -> length(x) >= {LEAST_LENGTH}))"


def parse(query: str) -> tuple[list[str], list[str], list[str]]:
    """Required, excluded and optional words; operators beyond + and - are error 1235."""
    if found := re.search(r'["*()<>~@]', query):
        raise EngineError(1235, f"Full-text operator {found[0]} is not supported")
    groups: tuple[list[str], list[str], list[str]] = ([], [], [])
    for part in query.split():
        kind = 0 if part[0] == "+" else 1 if part[0] == "-" else 2
        words = [w for w in re.split(r"[^a-z0-9]+", part.translate(str.maketrans(_UPPER, _LOWER))) if len(w) >= LEAST_LENGTH]
        groups[kind].extend(words)
    return groups


def match_sql(columns: list[str], query: str) -> str:
    """SQL condition: all required words, no excluded one, and without required ones any optional one."""
    required, excluded, optional = parse(query)
    if not required and not optional:
        return "false"
    text = columns[0] if len(columns) == 1 else f"concat_ws(' ', {', '.join(columns)})"
    array = lambda words: f"array({', '.join(map(quote, words))})"
    tests = []
    if required:
        tests.append(f"size(array_except({array(required)}, w)) = 0")
    else:
        tests.append(f"arrays_overlap(w, {array(optional)})")
    if excluded:
        tests.append(f"NOT arrays_overlap(w, {array(excluded)})")
    # A text is split, once, only if the words stand in it at all.
    lower = f"translate(coalesce(CAST({text} AS STRING), ''), '{_UPPER}', '{_LOWER}')"
    held = " AND ".join(f"contains({lower}, {quote(w)})" for w in required) or " OR ".join(f"contains({lower}, {quote(w)})" for w in optional)
    return f"(({held}) AND exists(array({tokens_sql(text)}), w -> {' AND '.join(tests)}))"
