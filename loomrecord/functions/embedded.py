"""JSON objects and arrays inside prose."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

#: All that matters to the nesting of containers.
_MARKS = re.compile(r'["\\{}\[\]]')
_OPENING = {"}": "{", "]": "["}
FOUND = "array<struct<start:int,end:int,source:string>>"


def _no_constant(name: str):
    raise ValueError(name)


def _parses(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False
    return True


def containers(text: str) -> list[tuple[int, int]]:
    """(start, end) of all balanced containers, by start.

    Quotes count inside containers only, and brackets inside quotes don't. A bracket of
    the wrong kind gives up all that is open there; what was closed before stays.
    """
    done, stack, quoted, skip = [], [], False, -1
    for mark in _MARKS.finditer(text):
        at, c = mark.start(), mark.group()
        if quoted:
            if at == skip:
                continue
            if c == "\\":
                skip = at + 1
            elif c == '"':
                quoted = False
        elif c in "{[":
            stack.append((c, at))
        elif stack and c == '"':
            quoted, skip = True, -1
        elif stack and c in "}]":
            kind, start = stack[-1]
            if kind == _OPENING[c]:
                stack.pop()
                done.append((start, at + 1))
            else:
                stack.clear()
    return sorted(done)


def outermost_json(text: str | None, most: int, budget: int = 1 << 24) -> list[dict]:
    found, last = [], 0
    for start, end in containers(text or ""):
        if start < last or end - start > budget:
            continue
        budget -= end - start
        if _parses(text[start:end]):
            found.append({"start": start, "end": end, "source": text[start:end]})
            last = end
            if len(found) == most:
                break
    return found


def embedded_json(text, most: int = 4, budget: int = 1 << 24):
    """The first `most` outermost valid objects and arrays in a text, with their places in code points.

    Null and plain texts give an empty array. Where an outer container is broken, valid
    ones inside it are taken. Containers nested deeper than Python's parser goes are
    passed over, and so are those beyond `budget` characters parsed of one text: of
    broken nests, every level is tried.
    """
    @F.pandas_udf(FOUND)
    def scan(column: pd.Series) -> pd.Series:
        return column.map(lambda t: outermost_json(t, most, budget))
    return scan(text)
