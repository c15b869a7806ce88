"""Edits of comments that name a removed flag. Each takes and gives plain text; a comment that also says something else keeps that."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .scanner import Unreadable, scan

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z`\"'(])")
_ITEM = re.compile(r"\s*,\s*(?:and\s+|or\s+)?|\s+(?:and|or)\s+")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)


def _token(key: str) -> re.Pattern[str]:
    return re.compile(rf"(?<![A-Za-z0-9_-]){re.escape(key)}(?![A-Za-z0-9_-])")


def without_sentence(text: str, key: str) -> str:
    """The text of a comment without sentences that name the key; empty if all do."""
    named = _token(key)
    return " ".join(s for s in _SENTENCE.split(text.strip()) if not named.search(s))


def without_item(text: str, key: str, family: frozenset[str] = frozenset()) -> str:
    """The text without the key's item in a list of keys (`a, b and c`) or of `k=v` pairs. A list whose other items aren't keys of the family is left."""
    named = _token(key)
    m = re.search(r"[\w.-]+(?:=[\w.-]+)?(?:(?:\s*,\s*(?:and\s+|or\s+)?|\s+(?:and|or)\s+)[\w.-]+(?:=[\w.-]+)?)+", text)
    while m and not named.search(m[0]):
        m = re.compile(r"[\w.-]+(?:=[\w.-]+)?(?:(?:\s*,\s*(?:and\s+|or\s+)?|\s+(?:and|or)\s+)[\w.-]+(?:=[\w.-]+)?)+").search(text, m.end())
    if not m:
        return text
    items = _ITEM.split(m[0])
    kept = [i for i in items if i.split("=")[0] != key]
    if len(kept) == len(items) or not kept or not all("=" in i or i in family for i in kept):
        return text
    word = re.search(r"\s(and|or)\s", m[0])
    joined = ", ".join(kept[:-1]) + (f" {word[1]} " if word and len(kept) > 1 else ", " if len(kept) > 1 else "") + kept[-1]
    return text[: m.start()] + joined + text[m.end() :]


def without_clause(text: str, key: str) -> str:
    """The text without a clause after a comma, semicolon or dash that alone names the key."""
    parts = re.split(r"(\s*[,;]\s+|\s+[-–—]\s+)", text)
    named = _token(key)
    hit = [k for k in range(0, len(parts), 2) if named.search(parts[k])]
    if len(hit) != 1 or not hit[0]:
        return text
    return "".join(parts[: hit[0] - 1] + parts[hit[0] + 1 :])


def delete_only(source: str, key: str, jsx: bool = False, language: str = "") -> str:
    """A source without line comments that are about the key alone: each of their sentences names it. Only text between tokens is looked at; a source that doesn't scan is left."""
    if "//" not in source:
        return source
    named = _token(key)
    try:
        tokens, tail = scan(source, jsx, language)
    except Unreadable:
        return source

    def lean(gap: str, own_line: bool) -> str:
        """The gap without comment lines about the key; own_line: whether it begins a line."""
        lines = gap.split("\n")
        kept = []
        for k, line in enumerate(lines):
            m = re.match(r"^\s*//+\s?(.*)$", line)
            if m and (k or own_line) and k + 1 < len(lines) and named.search(m[1]) and not without_sentence(m[1], key):
                continue
            kept.append(line)
        return "\n".join(kept)

    for k, t in enumerate(tokens):
        if "//" in t.gap:
            t.gap = lean(t.gap, not k)
    if "//" in tail:
        ended = tail.endswith("\n")
        tail = lean(tail if ended else tail + "\n", not tokens)
        tail = tail if ended else tail.removesuffix("\n")
    return "".join(t.gap + t.text for t in tokens) + tail


def titles(source: str, key: str) -> str:
    """Test titles without the condition that the flag is on or off."""
    if key not in source:
        return source
    flag = rf"[`'\"]?(?<![\w-]){re.escape(key)}(?![\w-])[`'\"]?"
    return re.sub(rf"(\b(?:it|test|describe)(?:\.\w+)?\(\s*)(['\"`])((?:(?!\2).)*?)[ ,]*(?:\b(?:when|if|with)\s+(?:the\s+)?(?:flag\s+)?{flag}(?:\s+flag)?\s+(?:is\s+)?(?:on|off|enabled|disabled))", r"\1\2\3", source)


def only_in_comments(source: str | None, key: str, language: str = "") -> bool | None:
    """Whether every mention of the key stands in a comment; null for a source that can't be read."""
    if source is None:
        return None
    named = _token(key)
    if not named.search(source):
        return False
    try:
        tokens, _ = scan(source, language=language)
    except Unreadable:
        return None
    code = "".join(("" if _COMMENT.search(t.gap) is None and not t.gap else " ") + t.text for t in tokens)
    return not named.search(code)


@F.pandas_udf(BooleanType())
def comment_only(source: pd.Series, key: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([only_in_comments(s, k, x or "") for s, k, x in zip(source, key, language, strict=True)], dtype=object)


def tidy(source: str, key: str, jsx: bool = False, language: str = "") -> str:
    """A source without comments and title conditions that are about the key alone."""
    return titles(delete_only(source, key, jsx, language), key)


def is_generated(source, path):
    """Whether a file says in its first five lines, or by its name, that a machine wrote it."""
    head = F.array_join(F.slice(F.split(source, "\n", -1), 1, 5), "\n")
    marked = head.rlike(r"(?i)(@generated|code generated .* do not edit|auto-?generated|this file was generated)")
    return F.coalesce(marked, F.lit(False)) | path.rlike(r"(\.g\.dart|\.pb\.go|_pb2\.py|\.generated\.\w+|\.min\.js)$")
