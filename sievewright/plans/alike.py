"""Sources that differ in whole numbers alone, or in the numbers that their names end with: one reading says what becomes of all of them.

Scanner, grammar, scopes and folds tell a number by its first digit and never read its value, and ask of names only whether they are the same. So a number
that is a token of its own, or the end of a name or of a word in a string, goes where its place in the source goes. Sources are met again by their text between such numbers and
by which of these are equal. From the second one on their fold (or their symbols, or their sites) is made once, of a source with
marks for the numbers, and written with each one's own. Where that can't be shown (a number within a template, a comment, markup or a string with escapes, beside the key in a string,
a refused or unreadable file) each source is read for itself. Every source is still read whole, and each gets rows of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter
from typing import NamedTuple

from ..functions.scanner import Token, Unreadable, scanned

#: Digits that may be a token of their own or end a word. Which do is for the scanner to say.
_NUMBER = re.compile(r"([0-9](?:(?<=[A-Za-z_].)(?<![0-9\\][A-Za-z_].)[0-9]*(?![\w$])|(?<![\w$.\\].)[0-9]*(?![\w.$])))")
#: Longer sources are read for themselves, and so many are remembered, so that what is remembered stays small.
LONGEST, REMEMBERED = 8192, 512
#: Between texts that are met as one.
_BETWEEN = "\0"


class _Form(NamedTuple):
    """A result with {n} for the n-th number of those that differ. texts: its strings, one after another; shape: the result with places in texts for strings; fixed and steps: how it is put together."""

    texts: str
    shape: object
    fixed: list
    steps: list[Callable]
    ends: list[int]
    width: int


def parted(text: str, keep: frozenset[str] = frozenset()) -> tuple[tuple[str, ...], tuple[int, ...], list[str]]:
    """The text between numbers, for each number which of those that differ it is, and all of them in order. keep: numbers that stay text."""
    pieces = _NUMBER.split(text)
    if keep and not keep.isdisjoint(pieces[1::2]):
        parts, numbers = [pieces[0]], []
        for n, after in zip(pieces[1::2], pieces[2::2], strict=True):
            if n in keep:
                parts[-1] += n + after
            else:
                numbers.append(n)
                parts.append(after)
    else:
        parts, numbers = pieces[::2], pieces[1::2]
    place: dict[str, int] = {}
    return tuple(parts), tuple([place.setdefault(n, len(place)) for n in numbers]), numbers


def _whole(t: Token, mark: str, key: str) -> bool:
    """Whether a token with a mark is a number, a name that ends with it, or a plain string that doesn't name the key."""
    if mark in t.gap:
        return False
    if t.kind == "num":
        return t.text[5:].isdigit() and t.text.startswith(mark) and len(t.text) == len(mark) + 5
    if t.kind == "id":
        return t.text.count(mark) == 1 and t.text[-5 - len(mark) :].startswith(mark)
    return t.kind == "str" and "\\" not in t.text and not (key and key in t.text)


def _form(parts: tuple[str, ...], order: tuple[int, ...], asked: tuple, key: str, markup: bool, language: str, read: Callable) -> _Form | None:
    """What is read of all sources with these parts between numbers; null where numbers may decide something."""
    stem = 70001
    while str(stem) in key or str(stem) in repr(asked) or any(str(stem) in p for p in parts):
        stem += 2
    mark = str(stem)
    marks = [f"{mark}{n:05d}" for n in range(max(order, default=-1) + 1)]
    source = "".join(x for p, n in zip(parts, [*order, None], strict=True) for x in (p, "" if n is None else marks[n]))
    texts, place, mentions = [], {m: n for n, m in enumerate(marks)}, re.compile(f"({mark}[0-9]{{5}})")

    def put(x: object) -> object:
        """A result with places in texts for its strings that have a mark."""
        if isinstance(x, str):
            pieces = mentions.split(x)
            if any(mark in p for p in pieces[::2]) or any(p not in place for p in pieces[1::2]) or _BETWEEN in x:
                raise Unreadable("a number was cut")
            if len(pieces) == 1:
                return x
            texts.append("".join(p.replace("{", "{{").replace("}", "}}") if not k % 2 else f"{{{place[p]}}}" for k, p in enumerate(pieces)))
            return _Text(len(texts) - 1)
        if isinstance(x, list | tuple):
            held = [put(y) for y in x]
            kind = list if isinstance(x, list) else tuple
            return _Held(held, kind) if any(isinstance(y, _Text | _Held) for y in held) else kind(x)
        return x

    try:
        first, *others = source.split(_BETWEEN)
        tokens, _ = scanned(first, markup, language)
        if not all(_whole(t, mark, key) for t in tokens if mark in t.text or mark in t.gap) or sum(t.text.count(mark) for t in tokens) != first.count(mark):
            return None
        shape = put(read(first, *others, *asked))
    except (ValueError, SyntaxError, RecursionError, IndexError, KeyError, StopIteration):
        return None
    ends, width = [], len(mark) + 5
    for p in parts[:-1]:
        ends.append((ends[-1] if ends else 0) + len(p) + width)
    fixed, steps = _steps(shape, len(texts)) if texts else ([], [])
    return _Form(_BETWEEN.join(texts), shape, fixed, steps, ends, width)


class _Text(NamedTuple):
    """The place of a string in a form's texts."""

    at: int


class _Held(NamedTuple):
    """A list or tuple of a form that has such places."""

    items: list
    kind: type


def _steps(shape: object, texts: int) -> tuple[list, list[Callable]]:
    """What doesn't change, and how the rest is put together from texts, from that and from what steps before gave: the last gives the result."""
    fixed, steps, places = [], [], []

    def place(x: object) -> tuple[bool, int]:
        if isinstance(x, _Text):
            return False, x.at
        if isinstance(x, _Held):
            held = [place(y) for y in x.items]
            places.append((held, x.kind))
            return True, len(places) - 1
        fixed.append(x)
        return False, texts + len(fixed) - 1

    place(shape if isinstance(shape, _Held) else _Held([shape], tuple))
    for held, kind in places:  # what is made goes behind all that is fixed
        at = [n + (texts + len(fixed)) * made for made, n in held]
        get = itemgetter(*at) if len(at) > 1 else lambda pool, n=at[0]: (pool[n],)
        steps.append(get if kind is tuple else lambda pool, get=get: [*get(pool)])
    return fixed, steps


def _filled(one: _Form, numbers: Iterable[str]) -> object:
    """The result of a source with these numbers."""
    if not one.steps:
        return one.shape
    pool = [*one.texts.format(*numbers).split(_BETWEEN), *one.fixed]
    for step in one.steps:
        pool.append(step(pool))
    return pool[-1] if isinstance(one.shape, _Held) else pool[-1][0]


def _digits(words: Iterable[str]) -> frozenset[str]:
    """The numbers in words, which stay as they are in sources."""
    return frozenset(n for x in words for n in re.findall("[0-9]+", x))


def rows_alike(read: Callable, markup: Sequence[str], words: Iterable[str] = ()) -> Callable:
    """done(language, asked, source, *others): what read(source, *others, language, *asked) gives, made of strings, numbers and lists, of which that of sources that are alike is made once.

    asked: what is not a text. words: what read looks for by itself.
    """
    keep = _digits(words)
    seen = lru_cache(maxsize=REMEMBERED)(lambda *met: [])

    def done(language: str, asked: tuple, source: str, *others: str) -> object:
        text = _BETWEEN.join((source, *others)) if others else source
        if len(text) > LONGEST or text.count(_BETWEEN) != len(others):
            return read(source, *others, language, *asked)
        parts, order, numbers = parted(text, keep)
        times = seen(parts, order, language, asked)
        if not times:  # a source that none is like costs nothing more than this
            times.append(None)
            return read(source, *others, language, *asked)
        if len(times) == 1:
            times.append(_form(parts, order, (language, *asked), "", language in markup, language, read))
        one = times[1]
        if one is None:
            return read(source, *others, language, *asked)
        return _filled(one, dict.fromkeys(numbers))

    return done


def alike(fold: Callable, words: Iterable[str] = ()) -> Callable:
    """fold(source, key, value, language, known), of whose results (after, reads, reason, findings, left, made, gone, more) those of sources that are alike are made once. words: what fold looks for by itself."""
    from .fold import MARKUP  # folds read names by `symbols`, which reads alike sources once

    def whole(source: str, key: str, value: bool, language: str, known: tuple) -> tuple:
        out = fold(source, key, value, language, known)
        if out[2]:
            raise Unreadable(out[2])
        return out

    seen = lru_cache(maxsize=REMEMBERED)(lambda *met: [])
    own = _digits(words)
    told = lru_cache(maxsize=REMEMBERED)(lambda key, known: own | _digits([key, *(x for k in known for x in (k.name, k.member))]))

    def done(source: str, key: str, value: bool, language: str, known: tuple) -> tuple:
        if not key or len(source) > LONGEST or _BETWEEN in source:
            return fold(source, key, value, language, known)
        parts, order, numbers = parted(source, told(key, known))
        times = seen(parts, order, key, value, language, known)
        if not times:
            times.append(None)
            return fold(source, key, value, language, known)
        if len(times) == 1:
            times.append(_form(parts, order, (key, value, language, known), key, language in MARKUP, language, whole))
        one = times[1]
        if one is None:
            return fold(source, key, value, language, known)
        out = list(_filled(one, dict.fromkeys(numbers)))
        if gone := out[6]:
            wide = list(accumulate(map(len, numbers), initial=0))
            before = lambda at: at - one.width * (n := bisect_right(one.ends, at)) + wide[n]
            out[6] = [(before(a), before(b)) for a, b in gone]
        return tuple(out)

    return done
