"""Functions over whole texts: lines, diffs, spans, JSON with comments."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def lines(text: Column) -> Column:
    """Lines split at \\n alone; the empty piece after a last line break is no line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def line_of(text: Column, needle: Column) -> Column:
    """Number (from 1) and text of the first line that holds a needle; null if none does."""
    found = F.position(needle, text)
    before = F.substring(text, F.lit(1), found - 1)
    number = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.when(found > 0, F.struct(number.cast("int").alias("line"), F.get(F.split(text, "\n", -1), number.cast("int") - 1).alias("text")))


def unified(path: str, before: str, after: str | None) -> str:
    """A unified diff of one file, split at \\n alone; a deleted file goes to /dev/null."""
    if before == after:
        return ""

    def cut(x: str) -> list[str]:
        parts = x.split("\n")
        return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])

    out = []
    for line in difflib.unified_diff(cut(before), cut(after or ""), f"a/{path}", "/dev/null" if after is None else f"b/{path}"):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


@F.pandas_udf(StringType())
def diff(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified diff of each row's before and after; empty where they are equal."""
    return pd.Series([unified(p, b or "", a) for p, b, a in zip(path, before, after, strict=True)], dtype=object)


@F.pandas_udf(IntegerType())
def depth(text: pd.Series) -> pd.Series:
    """The deepest nesting of brackets; closing ones that open nothing count back below zero and are ignored."""
    step = np.zeros(256, np.int32)
    step[list(b"([{")], step[list(b")]}")] = 1, -1
    return text.map(lambda x: None if x is None else int(max(0, np.cumsum(step[np.frombuffer(x.encode(), np.uint8)]).max(initial=0)))).astype("Int32")


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("removed", ArrayType(StringType()))]))
def without_keys(text: pd.Series, section: pd.Series, keys: pd.Series) -> pd.DataFrame:
    """JSON with comments without these keys of a section (dotted; empty: the top), everything else byte for byte, and the keys removed."""
    rows = [remove_keys(t, s or "", list(k)) if t is not None else (None, []) for t, s, k in zip(text, section, keys, strict=True)]
    return pd.DataFrame(rows, columns=["text", "removed"])


def _skip(s: str, i: int) -> int:
    """The place of the next character that is neither white space nor in a comment."""
    while i < len(s):
        if s[i].isspace() or s[i] == "\ufeff":
            i += 1
        elif s.startswith("//", i):
            i = s.find("\n", i)
            i = len(s) if i < 0 else i
        elif s.startswith("/*", i):
            i = s.find("*/", i)
            i = len(s) if i < 0 else i + 2
        else:
            break
    return i


def _string(s: str, i: int) -> int:
    """The place after a string that starts at i."""
    i += 1
    while i < len(s) and s[i] != '"':
        i += 2 if s[i] == "\\" else 1
    if i >= len(s):
        raise ValueError("a string does not end")
    return i + 1


def _value(s: str, i: int) -> int:
    """The place after a value that starts at i."""
    if s[i : i + 1] == '"':
        return _string(s, i)
    if s[i : i + 1] in ("{", "["):
        level = 0
        while i < len(s):
            i = _skip(s, i)
            c = s[i : i + 1]
            if c == '"':
                i = _string(s, i)
                continue
            level += (c in "{[") - (c in "}]") if c else 0
            i += 1
            if not level:
                return i
        raise ValueError("a bracket does not close")
    while i < len(s) and s[i] not in ",}]" and not s[i].isspace() and not s.startswith(("//", "/*"), i):
        i += 1
    return i


def _members(s: str, i: int) -> list[tuple[str, int, int, int]]:
    """(name, start, value start, end) of each member of the object at i."""
    out, i = [], _skip(s, i + 1)
    while s[i : i + 1] == '"':
        end = _string(s, i)
        colon = _skip(s, end)
        if s[colon : colon + 1] != ":":
            raise ValueError("a name without a value")
        value = _skip(s, colon + 1)
        stop = _value(s, value)
        out.append((s[i + 1 : end - 1], i, value, stop))
        i = _skip(s, stop)
        if s[i : i + 1] == ",":
            i = _skip(s, i + 1)
    if s[i : i + 1] != "}":
        raise ValueError("an object does not close")
    return out


def _target(s: str, path: list[str]) -> list[int]:
    """Places of the objects from the root down a path, names in any case; fewer than the path is long if a part is missing."""
    at = [_skip(s, 0)]
    for name in path if s[at[0] : at[0] + 1] == "{" else ():
        place = next((v for n, _, v, _ in _members(s, at[-1]) if n.lower() == name.lower() and s[v] == "{"), -1)
        if place < 0:
            break
        at.append(place)
    return at


def _without_member(s: str, holder: int, name: str) -> str:
    """The text without a member of the object at holder, and without the comma that it no longer needs."""
    members = _members(s, holder)
    k = next(k for k, m in enumerate(members) if m[0].lower() == name)
    start, end = members[k][1], members[k][3]
    if k + 1 < len(members):
        end = members[k + 1][1]
    elif k:
        start = members[k - 1][3]
    elif s[_skip(s, end) : _skip(s, end) + 1] == ",":
        end = _skip(s, end) + 1
    return s[:start] + s[end:]


def _plain(s: str, at: int) -> object:
    """What an object says: its members by name in lower case; any other value as it is written."""
    return [(n.lower(), _plain(s, v)) for n, _, v, _ in _members(s, at)] if s[at] == "{" else s[at : _value(s, at)]


def remove_keys(text: str, section: str, keys: list[str]) -> tuple[str, list[str]]:
    """Cut members out of a section (dotted), names in any case; a section that this would empty goes itself. A text is left as it is if it can't be read, names one of the keys twice, or would then say anything else."""
    path, wanted = [p for p in section.split(".") if p], {k.lower() for k in keys}
    try:
        at = _target(text, path)
        if len(at) <= len(path) or text[at[-1] : at[-1] + 1] != "{":
            return text, []
        names = [m[0] for m in _members(text, at[-1])]
        gone = [n for n in names if n.lower() in wanted]
        if not gone or len({n.lower() for n in gone}) < len(gone):
            return text, []
        whole = path and len(gone) == len(names)
        after, cuts = text, [path[-1].lower()] if whole else [n.lower() for n in gone]
        for name in cuts:
            after = _without_member(after, _target(after, path[:-1] if whole else path)[-1], name)

        def left(members, depth):
            if depth == len(path) - bool(whole):
                return [m for m in members if m[0] not in cuts]
            return [(n, left(v, depth + 1) if n == path[depth].lower() and isinstance(v, list) else v) for n, v in members]

        same = _plain(after, _skip(after, 0)) == left(_plain(text, at[0]), 0)
    except (ValueError, IndexError):
        return text, []
    return (after, gone) if same else (text, [])
