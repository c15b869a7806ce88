"""Whole-token predicates: does a text name a key or an identifier?

A null text is unknown, not false: every predicate takes what to say for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes on whose outside a token ends.
KEY, IDENTIFIER, DOTTED = "A-Za-z0-9_-", "A-Za-z0-9_", r"\w.-"


def quoted(name: str) -> str:
    r"""A name as literal text of a Java pattern."""
    return "\\Q" + name.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def mentions(text: Column, name: str, inside: str = KEY, unknown: bool | None = None) -> Column:
    """Whether text names `name` with no character of the class on either side. The plain substring test runs first: it is cheap and most rows fail it."""
    flags = "(?U)" if inside == DOTTED else ""
    found = F.contains(text, F.lit(name)) & text.rlike(f"{flags}(?<![{inside}]){quoted(name)}(?![{inside}])")
    return found if unknown is None else F.coalesce(found, F.lit(unknown))


def mentions_key(text: Column, key: str, unknown: bool | None = None) -> Column:
    """Whether text names a flag key as a token of letters, digits, `_` and `-`."""
    return mentions(text, key, KEY, unknown)


def key_token(text: Column, key: str, unknown: bool | None = None) -> Column:
    """Whether text names a key bounded by anything but Unicode word characters, `.` and `-`."""
    return mentions(text, key, DOTTED, unknown)


def mentions_any(text: Column, names: Iterable[str], unknown: bool | None = None) -> Column:
    """Whether text names any of the identifiers; `$` ends a token. No names: never."""
    names = sorted(set(names))
    if not names:
        return F.lit(False)
    found = text.rlike(f"(?<![{IDENTIFIER}])(?:{'|'.join(map(quoted, names))})(?![{IDENTIFIER}])")
    return found if unknown is None else F.coalesce(found, F.lit(unknown))


def tokens(text: Column, inside: str = IDENTIFIER) -> Column:
    """The distinct tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{inside}]+)"), F.lit(1)))


def fused(before: Column, after: Column) -> Column:
    """Identifiers that a rewrite made and its source never had."""
    word = r"([A-Za-z_$][A-Za-z0-9_$]*)"
    return F.array_except(F.regexp_extract_all(after, F.lit(word), F.lit(1)), F.regexp_extract_all(before, F.lit(word), F.lit(1)))


def references(text: Column, name: str) -> Column:
    """How often a text names an identifier."""
    return F.regexp_count(text, F.lit(f"(?<![{IDENTIFIER}]){quoted(name)}(?![{IDENTIFIER}])"))


def is_dead(status: Column) -> Column:
    return F.lower(status) == "dead"


def whole_name(name: str, inside: str) -> bool:
    """Whether a name is itself one token of the class, so that an equality join of tokens finds it."""
    return re.fullmatch(f"[{inside}]+", name) is not None
