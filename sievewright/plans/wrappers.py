"""Functions around a flag: members whose whole body is one read, gates in markup, calls without effects, comments at calls."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scanner import Token, Unreadable, closing, content, scan, text
from ..sources.config import Accessor, Gate
from .fold import MARKUP, _alone, _ends_line


def discover(source: str, key: str, accessors: list[Accessor]) -> list[tuple[str, bool]]:
    """(name, negated) of each function or method without parameters whose body only returns a read of the key."""
    names = {a.name: a for a in accessors}
    out = []
    try:
        tokens, _ = scan(source)
    except Unreadable:
        return out
    for i in range(1, len(tokens) - 6):
        if tokens[i].text != "(" or tokens[i + 1].text != ")" or tokens[i - 1].kind != "id":
            continue
        k = i + 2
        while k < len(tokens) and tokens[k].text in (":", "boolean", "bool", "=>"):
            k += 1
        name = i - 1
        if tokens[k - 1].text == "=>" and i >= 2 and tokens[i - 1].text == "=":
            name = i - 2
        if tokens[k].text != "{":
            continue
        body = tokens[k + 1 : closing(tokens, k)]
        if body and body[0].text == "return":
            body = body[1:]
            if body and body[-1].text == ";":
                body = body[:-1]
            flip = bool(body) and body[0].text == "!"
            body = body[flip:]
            at = next((p for p, t in enumerate(body) if t.text == "("), -1)
            if at > 0 and (a := names.get(body[at - 1].text)) and all(t.kind == "id" or t.text == "." for t in body[:at]) and closing(body, at) == len(body) - 1:
                inner = body[at + 1 : -1]
                if a.position == 0 and len(inner) == 1 and inner[0].kind in ("str", "tpl") and content(inner[0].text) == key:
                    out.append((tokens[name].text, flip != a.negated))
    return out


def wrappers(files: DataFrame, key: str, accessors: list[Accessor]) -> DataFrame:
    """path, name and negated of each wrapper of the key."""

    def run(parts):
        for part in parts:
            yield pd.DataFrame([(p, n, g) for p, c in zip(part["path"], part["content"], strict=True) if c and key in c for n, g in discover(c, key, accessors)], columns=["path", "name", "negated"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, negated boolean")


def unwrap_gates(source: str, key: str, value: bool, gates: list[Gate]) -> tuple[str, int]:
    """Markup without gate elements of the key: a gate that shows keeps its children, one that hides goes with them. Gates with other attributes, spreads or unmatched tags stay."""
    done = 0
    for g in gates:
        opened = re.compile(rf"<{re.escape(g.component)}\s+{g.prop}=(?:\{{\s*)?(['\"]){re.escape(key)}\1(?:\s*\}})?\s*(/?)>")
        at = 0
        while m := opened.search(source, at):
            if m[2]:
                source = source[: m.start()] + source[m.end() :]
                done += 1
                continue
            depth, end = 1, None
            for t in re.compile(rf"<(/?){re.escape(g.component)}\b[^>]*?(/?)>").finditer(source, m.end()):
                depth += -1 if t[1] else 0 if t[2] else 1
                if not depth:
                    end = t
                    break
            if end is None:
                at = m.end()
                continue
            inner = source[m.end() : end.start()] if value else ""
            several = len(re.findall(r"(?s)^\s*<|\}\s*<|>\s*\{|/>\s*<|</\w+>\s*<", inner.strip())) > 1
            ahead = source[: m.start()].rstrip()
            if not inner.strip() and (ahead.endswith("=>") or re.search(r"(?:[(=?:,\[]|&&|\|\||\breturn)$", ahead)):
                inner = "null"
            elif inner and (several or not inner.strip().startswith("<")):
                inner = f"<>{inner}</>"
            source = source[: m.start()] + inner.strip() + source[end.end() :]
            done += 1
    return source, done


def _calls(tokens: list[Token], names: list[str]) -> list[tuple[int, int]]:
    """Stretches of the statements that only call one of the names, with arguments that have no effects."""
    out = []
    for i in range(len(tokens) - 2):
        if tokens[i].text not in names or tokens[i + 1].text != "(" or not (not i or tokens[i - 1].text in (";", "{", "}") or _ends_line(tokens, i)) or _alone(tokens, i):
            continue
        end = closing(tokens, i + 1)
        ended = end + 1 < len(tokens) and tokens[end + 1].text == ";"
        alone = ended or end + 1 == len(tokens) or tokens[end + 1].text == "}" or _ends_line(tokens, end + 1)
        if alone and not any(t.text in ("(", "++", "--", "=", "await", "yield") for t in tokens[i + 2 : end]):
            out.append((i, end + 1 + ended))
    return out


def without_calls(source: str, names: list[str], language: str = "", before: str | None = None) -> tuple[str, list[str]]:
    """A source without statements that only call functions declared to have no effects, and the names whose calls went. before: calls that this text has too stay."""
    tokens, tail = scan(source, language in MARKUP, language)
    plain = lambda ts, a, b: " ".join(t.text for t in ts[a:b])
    kept = Counter()
    if before is not None:
        old, _ = scan(before, language in MARKUP, language)
        kept.update(plain(old, a, b) for a, b in _calls(old, names))
    gone = []
    for a, b in reversed(_calls(tokens, names)):
        if kept[plain(tokens, a, b)]:
            continue
        gone.append(tokens[a].text)
        del tokens[a:b]
    return text(tokens, tail), gone[::-1]


def comments_at_calls(calls: DataFrame, comments: DataFrame, near: int = 2) -> DataFrame:
    """Comments (path, line, text) at most `near` lines above a call (path, line, name): an equality join on each line in reach."""
    reach = calls.select("path", "name", F.col("line").alias("call"), F.explode(F.sequence(F.col("line") - near, F.col("line"))).alias("line"))
    return reach.join(comments, ["path", "line"]).select("path", "name", "call", "line", "text").distinct()
