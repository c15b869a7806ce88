"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser reads the tags' expressions.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z were lower-cased; a phrase matches where its words stand
consecutively, overlaps included. An empty table gives no rows. A null or empty text has no words, no labels and score 0. Rows are looked at one by
one, so ties and repeated rows keep their rows, and other columns are left out. Texts of any length are read whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alnum_words, lean

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "eclipse public license": "epl",
    "all rights reserved": "all-rights-reserved",
}
# Identifiers, in lower case, of licences that allow reuse without copyleft.
PERMISSIVE = frozenset({
    "0bsd", "afl-3.0", "apache-1.0", "apache-1.1", "apache-2.0", "artistic-2.0", "blueoak-1.0.0", "bsd-1-clause",
    "bsd-2-clause", "bsd-2-clause-patent", "bsd-3-clause", "bsd-3-clause-clear", "bsd-4-clause", "bsl-1.0", "cc-by-1.0",
    "cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0", "cc0-1.0", "curl", "ecl-2.0", "fsfap", "ftl", "icu", "isc", "libpng",
    "libpng-2.0", "mit", "mit-0", "ms-pl", "ncsa", "openssl", "php-3.01", "postgresql", "psf-2.0", "python-2.0", "tcl",
    "unicode-3.0", "unicode-dfs-2016", "unlicense", "upl-1.0", "w3c", "wtfpl", "x11", "zlib", "zpl-2.1",
})
# Families of licence identifiers, in lower case; an identifier is one of these, or begins with one and a dash.
FAMILIES = frozenset({
    "0bsd", "afl", "agpl", "apache", "apsl", "artistic", "beerware", "blueoak", "bsd", "bsl", "busl", "catosl", "cc", "cc0", "cddl", "cecill", "cpal", "cpl", "curl", "ecl", "efl", "elastic",
    "epl", "eupl", "fsfap", "ftl", "gfdl", "gpl", "hpnd", "icu", "ijg", "ipl", "isc", "lgpl", "libpng", "lppl", "mit", "mpl", "ms", "mulanpsl", "ncsa", "npl", "nposl", "odbl", "ofl", "openssl",
    "osl", "php", "postgresql", "psf", "python", "qpl", "rpl", "ruby", "sspl", "tcl", "unicode", "unlicense", "upl", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl",
})
TAG_WORDS = "spdx license identifier"
_TAG = re.compile(r"SPDX-License-Identifier\s*:[ \t]*((?:(?!SPDX-License-Identifier)[A-Za-z0-9.+:() \t-])+)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_NAME = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str]:
    """The expression in postfix order, by the shunting-yard algorithm; with binds before and, and before or. ValueError if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK:
            if not operand:
                raise ValueError(f"{token} has nothing before it")
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                raise ValueError("an operator is missing before (")
            stack.append(token)
        elif token == ")":
            if not operand:
                raise ValueError(") has nothing before it")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError(") without (")
            stack.pop()
        else:
            if operand:
                raise ValueError(f"an operator is missing before {token}")
            out.append(low)
            operand = True
    if not operand:
        raise ValueError("the expression ends early")
    while stack:
        if stack[-1] == "(":
            raise ValueError("( without )")
        out.append(stack.pop())
    return out


def leading(captured: str) -> str:
    """The expression that captured text begins with: it ends before a second operand, a closing bracket too many, or the end of a comment or sentence."""
    operand, depth, end = False, 0, 0
    for m in _TOKEN.finditer(captured):
        token, stop = m[0], False
        if token.lower() in _RANK:
            operand = False
        elif token == "(":
            if operand and not depth:
                return captured[:end]
            depth += 1
        elif token == ")":
            if operand and not depth:
                return captured[:end]
            depth -= 1
        else:
            name = _NAME.match(token)
            if not depth and (operand or not name):
                return captured[:end]
            operand = True
            if not depth and name.end() < len(token):
                return captured[: m.start() + name.end()]
        end = m.end()
    return captured


def evaluate(postfix: list[str]) -> tuple[frozenset[str], bool]:
    """The licences named (exceptions after `with` are not) and whether permissive ones suffice: or needs one side, and both, with its left."""
    stack: list[tuple[frozenset[str], bool]] = []
    for token in postfix:
        if token in _RANK:
            (right, y), (left, x) = stack.pop(), stack.pop()
            stack.append((left, x) if token == "with" else (left | right, x or y if token == "or" else x and y))
        else:
            stack.append((frozenset([token]), token.removesuffix("+") in PERMISSIVE))
    return stack.pop()


def known(name: str) -> bool:
    """Whether an identifier is one of a licence, by its family; exceptions after `with` have no label of their own."""
    return name.removesuffix("+") in FAMILIES or any(name[:k] in FAMILIES for k, c in enumerate(name) if c == "-")


class Scanner:
    """Labels of one text at a time. Texts of any length are read whole, in time that grows with them."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG_WORDS: ""})):
            for phrase, label in phrases.items():
                found.setdefault(f" {phrase} ", []).append((kind, label))
        for phrase, values in found.items():
            self.automaton.add_word(phrase, (len(phrase), values))
        self.automaton.make_automaton()

    def scan(self, text: str) -> dict:
        words = alnum_words(text.encode())
        line = f" {b' '.join(words).decode()} "
        base, labels, places, tagged, notices = set(), set(), [], False, 0
        at = passed = 0  # blanks before a place of the line, counted on from the match before
        for end, (size, values) in self.automaton.iter(line):
            for kind, label in values:
                if kind == "base":
                    base.add(label)
                    start = end - size + 1
                    passed += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
                    at = start
                    places.append(passed)
                elif kind == "notice":
                    labels.add(label)
                    notices += 1
                else:
                    tagged = True
        expressions, permissive = [], None
        for m in _TAG.finditer(text) if tagged else ():
            try:
                expression = leading(m[1])
                names, free = evaluate(parse(expression))
            except ValueError:
                continue
            names = set(filter(known, names))
            if not names:
                continue
            expressions.append(" ".join(expression.split()))
            labels |= names
            permissive = free if permissive is None else permissive and free
        doubt = 0.4 ** min(len(places), 8) * 0.5 ** min(notices, 8) * 0.05 ** min(len(expressions), 4)
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": 1 - doubt,
            "expressions": ";".join(expressions), "permissive": permissive,
        }


_COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and what `Scanner.scan` finds in the text: words, base phrases and their places, labels, a score from 0 (no sign of a licence) towards 1, tag expressions, and whether they are met by permissive licences (null without one)."""
    kind = dict(docs.dtypes)["doc_id"]
    names = [x.split()[0] for x in _COLUMNS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [types[x.split()[1]] for x in _COLUMNS.split(", ")]

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, fields, strict=True))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, {_COLUMNS}")
