"""Declarations, imports, exports and references of a source, with the scope that each name belongs to.

A scope tree says what binds a name where it stands; only names of the module's own scope can be met from other files. Rows
come from sources by mapInArrow, a file at a time, and meet by joins (`resolved`): a reference's import names a module's
file, exports lead on from there, and what they end at is a declaration or nothing.

Kinds of rows: declaration (name, member of an object or class; its string in `target`), spread (name, an object into which `other` is spread), import (name; `other` in
the module `target`; `*`: the module itself), export (name, for `other` of this module, or of the module `target`; name `*`: all of that
one's), reference (name, member; removable: it is the key in a read; other: `call` without arguments, a `plain` value, or neither).
"""

from __future__ import annotations

import ast
from collections.abc import Sequence
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scanner import _OPEN, Token, Tokens, Unreadable, content, scan
from ..operators.relational import _cut, dealt, follow
from ..sources.config import Accessor
from .alike import rows_alike

#: Languages whose names are read here.
READ = ("ts", "tsx", "js", "python")
_JSX = ("tsx", "js")
SYMBOLS = "path string, kind string, name string, member string, target string, other string, removable boolean, line int"


class Symbol(NamedTuple):
    kind: str
    name: str
    member: str = ""
    target: str | None = None
    other: str | None = None
    removable: bool | None = None
    line: int | None = None


def matches(tokens: list[Token]) -> dict[int, int]:
    """The closing bracket of each opening one."""
    out, stack = {}, []
    for k, t in enumerate(tokens):
        if t.kind == "sign" and t.text in _OPEN:
            stack.append(k)
        elif t.kind == "sign" and t.text in _OPEN.values() and stack:
            out[stack.pop()] = k
    return out


class Scopes:
    """The scopes of a TypeScript or JavaScript source: stretches of tokens with the names they bind, the module's first."""

    def __init__(self, tokens: Tokens):
        self.t, self.match = tokens, matches(tokens)
        self.spans: list[tuple[int, int, set[str]]] = [(-1, len(tokens), set())]
        #: Places at which a name is bound, imported or exported.
        self.binding: set[int] = set()
        for k, t in enumerate(tokens):
            if t.kind == "tag" and t.text == "<":  # names of attributes are no names of the scope
                x = k + 2
                while x < len(tokens) and not (tokens[x].kind == "tag" and tokens[x].text in (">", "/>")):
                    if tokens[x].kind == "id":
                        self.binding.add(x)
                    x = self.match.get(x, x) + 1
        for o, c in self.match.items():
            if tokens[o].text == "{":
                self.spans.append((o, c, set()))
            elif tokens[o].text == "(":
                self._brackets(o, c)
        for k, t in enumerate(tokens):
            if t.kind == "id" and k + 1 < len(tokens):
                self._word(k, t.text)
        self.spans.sort(key=lambda s: (s[0], -s[1]))

    def text(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def _brackets(self, o: int, c: int) -> None:
        """Parameters, and the names in the heads of loops and handlers."""
        before, k = self.text(o - 1), c + 1
        if before in ("if", "while", "switch", "with"):
            return
        if self.text(k) == ":":  # a return type
            while k < len(self.t) and self.text(k) not in ("{", "=>", ";", ",", ")", "="):
                k = self.match.get(k, k) + 1
        if before in ("for", "catch", "await") or self.text(k) == "{":
            end = self.match.get(k, k)
            while before in ("for", "await") and self.text(k) != "{" and end < len(self.t) and self.text(end) not in (";", "}"):
                end = self.match.get(end, end) + 1
        elif self.text(k) == "=>":
            end = self._expression(k + 1)
        else:
            return
        names: set[str] = set()
        self.spans.append((o, end, names))
        if before not in ("for", "await"):
            self._pattern(o + 1, c, names)

    def _expression(self, k: int) -> int:
        """The end of an arrow's body."""
        if self.text(k) == "{":
            return self.match[k]
        while k < len(self.t) and self.text(k) not in (",", ";", ")", "]", "}"):
            if self.t[k].gap.count("\n") and self.t[k].kind == "id" and self.t[k - 1].kind in ("id", "str", "num", "tpl") and self.text(k - 1) != "=>":
                break
            k = self.match.get(k, k) + 1
        return k

    def _pattern(self, i: int, end: int, names: set[str]) -> None:
        """Names that a list of parameters or a pattern binds."""
        k, fresh = i, True
        while k < end:
            t = self.t[k]
            if t.text in ("{", "[") and fresh and t.kind == "sign":
                self._destructured(k + 1, self.match[k], names, t.text == "{")
                k, fresh = self.match[k], False
            elif k in self.match:
                k = self.match[k]
            elif t.kind == "id" and fresh and self.text(k + 1) in (",", ":", "=", "?", ")", "", "]", "}") or (t.kind == "id" and fresh and k + 1 == end):
                names.add(t.text)
                self.binding.add(k)
                fresh = False
            elif t.text == ",":
                fresh = True
            k += 1

    def _destructured(self, i: int, end: int, names: set[str], keyed: bool) -> None:
        k = i
        while k < end:
            t = self.t[k]
            if t.text in ("{", "[") and t.kind == "sign":
                self._destructured(k + 1, self.match[k], names, t.text == "{")
                k = self.match[k]
            elif t.text == "=":
                while k + 1 < end and self.text(k + 1) != ",":
                    k = self.match.get(k + 1, k + 1)
            elif t.kind == "id" and not (keyed and self.text(k + 1) == ":"):
                names.add(t.text)
                self.binding.add(k)
            elif t.kind == "id":
                self.binding.add(k)
            k += 1

    def _inside(self, k: int) -> set[str]:
        """The names of the innermost scope around a place."""
        best = self.spans[0]
        for s in self.spans:
            if s[0] < k <= s[1] and (s[0] > best[0] or (s[0] == best[0] and s[1] < best[1])):
                best = s
        return best[2]

    def _word(self, k: int, word: str) -> None:
        if self.text(k - 1) in (".", "?."):
            return
        if word in ("const", "let", "var") and self.text(k + 1) != "enum":
            j, depth_names = k + 1, self._inside(k)
            while True:
                if self.text(j) in ("{", "["):
                    self._destructured(j + 1, self.match[j], depth_names, self.text(j) == "{")
                    j = self.match[j] + 1
                elif j < len(self.t) and self.t[j].kind == "id":
                    depth_names.add(self.t[j].text)
                    self.binding.add(j)
                    j += 1
                while j < len(self.t) and self.text(j) not in (",", ";", "}", "of", "in") and not (self.text(j) != "=" and "\n" in self.t[j].gap and self.t[j].kind == "id" and self.t[j - 1].text != "="):
                    j = self.match.get(j, j) + 1
                if self.text(j) != ",":
                    return
                j += 1
        elif word in ("function", "class", "enum", "interface", "type", "namespace"):
            j = k + 1 + (self.text(k + 1) == "*")
            if j < len(self.t) and self.t[j].kind == "id" and (word not in ("type", "namespace") or self.text(j + 1) in ("=", "{", "<")):
                self._inside(k).add(self.t[j].text)
                self.binding.add(j)
        elif self.text(k + 1) == "=>" and word not in ("async",):
            self.spans.append((k - 1, self._expression(k + 2), {word}))
            self.binding.add(k)
        elif word == "import" and self.text(k + 1) not in ("(", "."):
            j = k + 1
            while j < len(self.t) and self.t[j].kind != "str":
                if self.t[j].kind == "id" and self.text(j) not in ("from", "type", "as"):
                    self.spans[0][2].add(self.t[j].text)
                self.binding.add(j)
                j += 1
        elif word == "export" and self.text(k + 1) in ("{", "*"):
            j = k + 1
            while j < len(self.t) and self.t[j].kind != "str" and self.text(j) != "}":
                self.binding.add(j)
                j += 1

    def of_module(self, k: int) -> bool:
        """Whether the name at k is the module's: no scope within it binds the name there, and it is neither a member, a key nor a binding."""
        t = self.t[k]
        if t.kind != "id" or k in self.binding or self.text(k - 1) in (".", "?."):
            return False
        if self.text(k + 1) == ":" and self.text(k - 1) in ("{", ",") and self._around(k) == "{":
            return False
        inner = [s for s in self.spans if s[0] < k <= s[1] and t.text in s[2]]
        return bool(inner) and max(inner, key=lambda s: (s[0], -s[1])) is self.spans[0]

    def _opened(self, k: int) -> int:
        """The place of the innermost bracket around a place; -1 at the top."""
        return max((o for o, c in self.match.items() if o < k < c), default=-1)

    def _around(self, k: int) -> str:
        return self.text(self._opened(k))

    def shorthand(self, k: int) -> bool:
        """Whether the name at k is both key and value of an object."""
        if self.text(k - 1) not in ("{", ",") or self.text(k + 1) not in (",", "}"):
            return False
        o = self._opened(k)
        return self.text(o) == "{" and (o == 0 or (self.t[o - 1].kind not in ("tag", "markup") and self.text(o - 1) not in (")", "=>", ";", "{", "}", "else", "try", "finally", "do")))


def _top(tokens: Tokens, match: dict[int, int]):
    """Places at the top of a source."""
    k = 0
    while k < len(tokens):
        yield k
        k = match.get(k, k) + 1


#: Members after a name that are read: an object in an object in a module.
DEEP = 3


def references(tokens: Tokens, scopes: Scopes, names: set[str] | None = None):
    """(place, name, members) of each use of a module's name; members: up to DEEP names after dots. names: only these."""
    for k, t in enumerate(tokens):
        if t.kind == "id" and (names is None or t.text in names) and scopes.of_module(k):
            members, j = [], k
            while len(members) < DEEP and scopes.text(j + 1) == "." and j + 2 < len(tokens) and tokens[j + 2].kind == "id":
                members.append(tokens[j + 2].text)
                j += 2
            yield k, t.text, members


def key_places(tokens: Tokens, accessors: list[Accessor]) -> set[tuple[int, int]]:
    """Stretches of the arguments of reads that name the key."""
    from .fold import _arguments, _named  # it reads names by this module

    found, names, match = set(), {a.name: a for a in accessors}, matches(tokens)
    for k in range(len(tokens) - 1):
        a = names.get(tokens[k].text) if tokens[k].kind == "id" else None
        if a and tokens[k + 1].text == "(":
            arguments = _arguments(tokens, k + 1, match[k + 1])
            if a.position < len(arguments) and not a.prop:
                found.add(_named(tokens, arguments[a.position]))
            elif a.position < len(arguments):
                s, e = arguments[a.position]
                found.update((j + 2, next(x for x in range(j + 2, e) if tokens[x].text in (",", "}"))) for j in range(s, e - 2) if tokens[j].text == a.prop and tokens[j + 1].text == ":" and any(tokens[x].text in (",", "}") for x in range(j + 2, e)))
    return found


def _entries(tokens: Tokens, match: dict[int, int], o: int, sign: str) -> tuple[list[tuple[str, str, int]], list[str]]:
    """Keys of an object or enum whose values are strings, those of objects within it after a dot, and the names that it spreads. What stands before a spread may be overridden, so it is no entry."""
    out, spread, k = [], [], o + 1
    while k < match[o]:
        key = tokens[k].text if tokens[k].kind == "id" else content(tokens[k].text) if tokens[k].kind == "str" else None
        if tokens[k].text == "...":
            out.clear()
            spread.append(tokens[k + 1].text if tokens[k + 2].text in (",", "}") else "")
        elif key and tokens[k + 1].text == sign and tokens[k + 2].kind in ("str", "tpl") and tokens[k + 3].text in (",", "}") and (v := content(tokens[k + 2].text)) is not None:
            out.append((key, v, k))
        elif key and tokens[k + 1].text == sign and tokens[k + 2].text == "{":
            inner, more = _entries(tokens, match, k + 2, sign)
            out += [] if more else [(f"{key}.{name}", v, at) for name, v, at in inner]
        while k < match[o] and tokens[k].text != ",":
            k = match.get(k, k) + 1
        k += 1
    return out, spread


def of_script(source: str, language: str, accessors: list[Accessor]) -> list[Symbol]:
    """The symbols of a TypeScript or JavaScript source."""
    tokens, _ = scan(source, language in _JSX, language)
    scopes, out, lines, n = Scopes(tokens), [], [], 1
    for t in tokens:
        n += t.gap.count("\n")
        lines.append(n)
        n += t.text.count("\n")
    text, match = scopes.text, scopes.match
    exported: set[str] = set()
    for k in _top(tokens, match):
        word = text(k)
        if tokens[k].kind != "id" or text(k - 1) in (".", "?."):
            continue
        if word == "import" and text(k + 1) not in ("(", "."):
            j, held = k + 1, []
            while j < len(tokens) and tokens[j].kind != "str":
                if text(j) == "{":
                    items, x = [], j + 1
                    while x < match[j]:
                        part = []
                        while x < match[j] and text(x) != ",":
                            part.append(text(x))
                            x += 1
                        x += 1
                        part = part[1:] if len(part) > 1 and part[0] == "type" and part[1] != "as" else part
                        if part:
                            items.append((part[-1], part[0]))
                    held += items
                    j = match[j]
                elif text(j) == "*" and text(j + 1) == "as":
                    held.append((text(j + 2), "*"))
                    j += 2
                elif tokens[j].kind == "id" and text(j) not in ("from", "type"):
                    held.append((text(j), "default"))
                j += 1
            if j < len(tokens):
                out += [Symbol("import", name, "", content(tokens[j].text), other, None, lines[k]) for name, other in held]
        elif word == "export" and text(k + 1) == "*" and text(k + 2) == "from" and k + 3 < len(tokens):
            out.append(Symbol("export", "*", "", content(tokens[k + 3].text), "*", None, lines[k]))
        elif word == "export" and text(k + 1) == "{":
            c = match[k + 1]
            target = content(tokens[c + 2].text) if text(c + 1) == "from" and c + 2 < len(tokens) else None
            x = k + 2
            while x < c:
                part = []
                while x < c and text(x) != ",":
                    part.append(text(x))
                    x += 1
                x += 1
                if part:
                    out.append(Symbol("export", part[-1], "", target, part[0], None, lines[k]))
        elif word == "export" and text(k + 1) == "default" and tokens[k + 2 : k + 3] and tokens[k + 2].kind == "id":
            name = text(k + 2) if text(k + 2) not in ("function", "class", "async") else text(k + 3)
            out.append(Symbol("export", "default", "", None, name, None, lines[k]))
        elif word == "export":
            j = k + 1
            while text(j) in ("declare", "abstract", "async"):
                j += 1
            if text(j) in ("const", "let", "var", "function", "class", "enum"):
                j += 1 + (text(j + 1) in ("enum", "*"))
                exported.add(text(j))
        if word == "const" and text(k + 1) != "enum" and k + 3 < len(tokens) and tokens[k + 1].kind == "id":
            j = k + 2
            if text(j) == ":":
                while j < len(tokens) and text(j) not in ("=", ";"):
                    j += 1
            after = text(j + 2)
            if text(j) == "=" and tokens[j + 1].kind in ("str", "tpl") and (after in (";", "as", "", "export", "const", "import") or "\n" in tokens[j + 2].gap) and (v := content(tokens[j + 1].text)) is not None:
                out.append(Symbol("declaration", text(k + 1), "", v, None, None, lines[k]))
            elif text(j) == "=" and text(j + 1) == "{":
                entries, spread = _entries(tokens, match, j + 1, ":")
                out += [Symbol("declaration", text(k + 1), key, v, None, None, lines[x]) for key, v, x in entries]
                out += [Symbol("spread", text(k + 1), "", None, x, None, lines[k]) for x in spread if len(spread) == 1 and x]
        elif word == "enum" and text(k + 2) == "{":
            out += [Symbol("declaration", text(k + 1), key, v, None, None, lines[x]) for key, v, x in _entries(tokens, match, k + 2, "=")[0]]
    out += [Symbol("export", name, "", None, name) for name in sorted(exported)]
    places = key_places(tokens, accessors)
    for k, name, members in references(tokens, scopes):
        for n in range(len(members) + 1):
            if (k, k + 1 + 2 * n) in places:
                out.append(Symbol("reference", name, ".".join(members[:n]), None, "plain", True, lines[k]))
                break
        else:
            out.append(Symbol("reference", name, ".".join(members), None, used_as(tokens, scopes, k, k + 1 + 2 * len(members)), False, lines[k]))
    return out


_CHANGES = frozenset({"=", "+=", "-=", "&&=", "||=", "??=", "++", "--"})


def used_as(tokens: Tokens, scopes: Scopes, k: int, end: int) -> str:
    """How the name (with members) from k to end is used: `call` without arguments, `plain` value, or neither."""
    before, after = scopes.text(k - 1), scopes.text(end)
    if before in ("new", "typeof", "++", "--", "&", "extends", "<", "...") or after in _CHANGES:
        return ""
    if after == "(":
        return "call" if scopes.match.get(end) == end + 1 and scopes.text(end + 2) not in (".", "?.", "[", "(") else ""
    if after in (".", "?.", "[", "=>", ":") or tokens[end : end + 1] and tokens[end].kind == "tpl" and not tokens[end].gap:
        return "" if after != ":" or before in ("{", ",", "(") else "plain"
    return "" if scopes.shorthand(k) else "plain"


def constants_of(tokens: Tokens) -> dict[tuple[str, str], bool]:
    """Names at a module's top that stand for true or false: functions without parameters that only return it (`call`), and constants (`value`)."""
    said = {"true": True, "false": False}
    if not any(t.text in said for t in tokens):
        return {}
    match, out = matches(tokens), {}
    text = lambda k: tokens[k].text if k < len(tokens) else ""

    def typed(k: int) -> int:
        if text(k) != ":":
            return k
        k += 1
        while k < len(tokens) and text(k) not in ("{", "=", "=>", ";"):
            k = match.get(k, k) + 1
        return k

    def returned(o: int) -> bool | None:
        inner = [t.text for t in tokens[o + 1 : match[o]]]
        return said.get(inner[1]) if inner[:1] == ["return"] and len(inner) >= 2 and inner[2:] in ([], [";"]) else None

    ended = lambda k: text(k) in (";", "") or "\n" in tokens[k].gap
    for k in _top(tokens, match):
        if tokens[k].kind != "id":
            continue
        if text(k) == "function" and text(k + 2) == "(" and match[k + 2] == k + 3 and text(k - 1) != "async":
            body = typed(k + 4)
            if text(body) == "{" and (v := returned(body)) is not None:
                out[text(k + 1), "call"] = v
        elif text(k) == "const" and k + 2 < len(tokens) and tokens[k + 1].kind == "id":
            at = typed(k + 2)
            if text(at) != "=":
                continue
            if text(at + 1) in said and ended(at + 2):
                out[text(k + 1), "value"] = said[text(at + 1)]
            elif text(at + 1) == "(" and match[at + 1] == at + 2 and text(body := typed(at + 3)) == "=>":
                v = returned(body + 1) if text(body + 1) == "{" else said.get(text(body + 1)) if ended(body + 2) else None
                if v is not None:
                    out[text(k + 1), "call"] = v
    return out


# -- Python


class PythonScopes(ast.NodeVisitor):
    """Which names of a Python source are the module's: `nodes` holds the loads that no function binds."""

    def __init__(self, tree: ast.Module):
        self.nodes: list[ast.Name] = []
        self._visit(tree, [])

    @staticmethod
    def _own(node: ast.AST) -> set[str]:
        """Names that a function, class or comprehension binds itself."""
        names, told = set(), set()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            names |= {a.arg for a in ast.walk(node.args) if isinstance(a, ast.arg)}
        todo = [*(node.body if isinstance(node.body, list) else [node.body])] if not isinstance(node, ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp) else [g.target for g in node.generators]
        while todo:
            n = todo.pop()
            if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load):
                names.add(n.id)
            elif isinstance(n, ast.Global):
                told.update(n.names)
            elif isinstance(n, ast.Import | ast.ImportFrom):
                names.update((a.asname or a.name).split(".")[0] for a in n.names)
            elif isinstance(n, ast.ExceptHandler) and n.name:
                names.add(n.name)
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                names.add(n.name)
                continue
            if not isinstance(n, ast.Lambda | ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
                todo += ast.iter_child_nodes(n)
        return names - told

    def _visit(self, node: ast.AST, around: list[tuple[ast.AST, set[str]]]) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                if not any(n.id in names for s, names in around if not isinstance(s, ast.ClassDef) or s is around[-1][0]):
                    self.nodes.append(n)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda | ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
                self._visit(n, [*around, (n, self._own(n))])
            else:
                self._visit(n, around)


def dotted(parents: dict[int, ast.AST], node: ast.Name) -> tuple[ast.expr, list[str]]:
    """The longest chain of up to DEEP attributes on a name, and its members."""
    top, members = node, []
    while len(members) < DEEP and isinstance(up := parents.get(id(top)), ast.Attribute) and isinstance(up.ctx, ast.Load):
        members.append(up.attr)
        top = up
    return top, members


def parents_of(tree: ast.AST) -> dict[int, ast.AST]:
    return {id(c): n for n in ast.walk(tree) for c in ast.iter_child_nodes(n)}


def of_python(source: str, accessors: list[Accessor]) -> list[Symbol]:
    """The symbols of a Python source; every name of a module is exported."""
    tree = ast.parse(source)
    out: list[Symbol] = []
    names = {a.name: a for a in accessors}

    def strings(body: list[ast.stmt], owner: str) -> None:
        for s in body:
            target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
            if isinstance(target, ast.Name):
                if not owner:
                    out.append(Symbol("export", target.id, "", None, target.id))
                if isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
                    out.append(Symbol("declaration", owner or target.id, target.id if owner else "", s.value.value, None, None, s.lineno))
            elif isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and not owner:
                out.append(Symbol("export", s.name, "", None, s.name))
                if isinstance(s, ast.ClassDef):
                    strings(s.body, s.name)
            elif isinstance(s, ast.ImportFrom) and not owner:
                told = "." * s.level + (s.module or "")
                for a in s.names:
                    if a.name == "*":
                        out.append(Symbol("export", "*", "", told, "*", None, s.lineno))
                    else:
                        out.append(Symbol("import", a.asname or a.name, "", told, a.name, None, s.lineno))
                        out.append(Symbol("export", a.asname or a.name, "", told, a.name, None, s.lineno))
            elif isinstance(s, ast.Import) and not owner:
                out.extend(Symbol("import", a.asname or a.name, "", a.name, "*", None, s.lineno) for a in s.names if a.asname or "." not in a.name)

    strings(tree.body, "")
    parents = parents_of(tree)

    def is_key(node: ast.expr) -> bool:
        call = parents.get(id(node))
        if isinstance(call, ast.keyword):
            word, call = call.arg, parents.get(id(call))
        else:
            word = None
        if not isinstance(call, ast.Call):
            return False
        a = names.get(call.func.id if isinstance(call.func, ast.Name) else getattr(call.func, "attr", ""))
        return a is not None and (word == a.prop if word else not a.prop and a.position < len(call.args) and call.args[a.position] is node)

    for n in PythonScopes(tree).nodes:
        top, members = dotted(parents, n)
        chain = [top]
        while chain[-1] is not n:
            chain.append(chain[-1].value)
        key = next((k for k, x in enumerate(chain) if is_key(x)), None)
        call = parents.get(id(top))
        use = "call" if isinstance(call, ast.Call) and call.func is top and not call.args and not call.keywords else "" if isinstance(call, ast.Attribute) or (isinstance(call, ast.Call) and call.func is top) else "plain"
        out.append(Symbol("reference", n.id, ".".join(members[: len(members) - (key or 0)]), None, use, key is not None, n.lineno))
    return out


def python_constants(source: str) -> dict[tuple[str, str], bool]:
    """The same for a Python module; a name that is bound twice stands for nothing."""
    out: dict[tuple[str, str], bool] = {}
    tree = ast.parse(source)
    bound = [n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load)] + [n.name for n in tree.body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
    for s in tree.body:
        if isinstance(s, ast.FunctionDef) and not s.decorator_list and not any([s.args.args, s.args.posonlyargs, s.args.kwonlyargs, s.args.vararg, s.args.kwarg]):
            body = [x for x in s.body if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant))]
            if len(body) == 1 and isinstance(body[0], ast.Return) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, bool):
                out[s.name, "call"] = body[0].value.value
        elif isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, bool):
            out[s.targets[0].id, "value"] = s.value.value
    return {k: v for k, v in out.items() if bound.count(k[0]) == 1}


# -- tables


#: The symbols of a file, as Arrow has them.
ARROW = pa.list_(pa.struct({**dict.fromkeys(Symbol._fields, pa.string()), "removable": pa.bool_(), "line": pa.int32()}))


def column(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Values as a column; lists of tuples become lists of structs without a dict for each."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    flat = [x for v in values for x in v]
    fields = [column(x, f.type) for x, f in zip(zip(*flat, strict=True) if flat else [()] * kind.value_type.num_fields, kind.value_type, strict=True)]
    offsets = pa.array(accumulate(map(len, values), initial=0), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(kind.value_type)), type=kind)


def values(column: pa.Array) -> list:
    """A column of strings or booleans as a list, in a fraction of the time of to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


def read_one(source: str | None, language: str, accessors: list[Accessor]) -> list[Symbol]:
    """The symbols of a source; one that can't be read has one of kind unreadable."""
    try:
        if source is None:
            raise Unreadable("no text")
        return of_python(source, accessors) if language == "python" else of_script(source, language, accessors) if language in READ else []
    except (Unreadable, SyntaxError, ValueError, RecursionError, IndexError):
        return [Symbol("unreadable", "")]


def symbols(files: DataFrame, accessors: list[Accessor]) -> DataFrame:
    """The symbols of files (path, language, content), a row each; a file that can't be read has one of kind unreadable."""
    reads = list(accessors)

    def run(batches):
        script = rows_alike(lambda source, language: read_one(source, language, reads), _JSX, map(repr, reads))
        for batch in batches:
            rows = []
            for path, language, source in zip(*(values(batch.column(c)) for c in ("path", "language", "content")), strict=True):
                found = read_one(source, language, reads) if source is None or language == "python" or language not in READ else script(language, (), source)
                rows += [(path, *s) for s in found]
            kinds = [pa.string()] * 6 + [pa.bool_(), pa.int32()]
            names = [x.split(" ")[0] for x in SYMBOLS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return dealt(files.select("path", "language", "content"), "path").mapInArrow(run, SYMBOLS)


def indexed(files: DataFrame, accessors: list[Accessor], index: str, parsed=None) -> DataFrame:
    """The symbols of files (path, language, content) by way of an index stored at a path: only contents that it doesn't hold are read.

    The index has a row for each content (digest of language, accessors and text) with its symbols; new ones are appended, so two paths of one content are
    read once, and a second run over a checkout with one file changed reads one. Contents that no file has any more stay until the index is dropped.
    parsed: an accumulator that counts the contents read.
    """
    spark = files.sparkSession
    reads, told = list(accessors), repr(sorted(map(repr, accessors)))
    keyed = files.withColumn("digest", F.sha2(F.concat_ws("\0", F.lit(told), "language", F.coalesce("content", F.lit("\0"))), 256))
    schema = "digest string, symbols array<struct<kind:string,name:string,member:string,target:string,other:string,removable:boolean,line:int>>"
    place = spark._jvm.org.apache.hadoop.fs.Path(index)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    held = spark.read.schema(schema).parquet(index) if there else spark.createDataFrame([], schema)
    new = keyed.join(held.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min(F.struct("language", "content")).alias("f")).select(F.col("digest").alias("path"), "f.language", "f.content")

    def counted(batches):
        for batch in batches:
            if parsed is not None:
                parsed.add(batch.num_rows)
            yield batch

    asked = new.mapInArrow(counted, "path string, language string, content string") if parsed is not None else new
    asked = _cut(spark, asked)
    rows = symbols(asked, reads).groupBy("path").agg(F.collect_list(F.struct("kind", "name", "member", "target", "other", "removable", "line")).alias("symbols"))
    asked.select(F.col("path").alias("digest")).join(rows.withColumnRenamed("path", "digest"), "digest", "left").select("digest", F.coalesce("symbols", F.array().cast("array<struct<kind:string,name:string,member:string,target:string,other:string,removable:boolean,line:int>>")).alias("symbols")).write.mode("append").parquet(index)
    now = spark.read.schema(schema).parquet(index).dropDuplicates(["digest"])
    return keyed.select("path", "digest").join(now, "digest").select("path", F.inline("symbols"))


def _from_where(asked: DataFrame) -> DataFrame:
    """asked (path, target, more) with what a module's name is read by: the file's directory (with its last slash) and whether it is Python."""
    return asked.withColumns({"directory": F.regexp_replace("path", r"[^/]*$", ""), "python": F.endswith("path", F.lit(".py"))})


def tried_modules(asked: DataFrame) -> DataFrame:
    """Files that a module's name may stand for (directory, python, target, rank, module), the first existing one counts. Files of one directory that name a module alike ask once."""
    asked = _from_where(asked).select("directory", "python", "target").distinct()
    parts = F.split("directory", "/")
    up = F.slice(parts, F.lit(1), F.size(parts) - 1)
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    named = F.replace(F.regexp_replace("target", r"^\.+", ""), F.lit("."), F.lit("/"))
    below = lambda d, name: F.when(F.size(d) == 0, name).otherwise(F.concat_ws("/", F.array_join(d, "/"), name))
    base = F.when(dots > 0, F.slice(up, F.lit(1), F.greatest(F.size(up) - dots + 1, F.lit(0))))
    roots = F.when(dots > 0, F.array(base)).otherwise(F.transform(F.sequence(F.size(up), F.lit(0), F.lit(-1)), lambda n: F.slice(up, F.lit(1), n)))
    python = F.flatten(F.transform(roots, lambda d: F.array(F.concat(below(d, named), F.lit(".py")), F.concat(below(d, named), F.lit("/__init__.py")))))
    steps = F.split("target", "/")
    climbed = F.aggregate(steps, up, lambda at, s: F.when(s == ".", at).when(s == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s))))
    asked = asked.withColumn("plain", F.when(~F.col("python") & F.startswith("target", F.lit(".")), F.array_join(climbed, "/")))  # a column, as it is asked many times
    plain = F.col("plain")
    endings = [".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js"]
    script = F.array(plain, *(F.concat(plain, F.lit(e)) for e in endings), *(F.concat(F.regexp_replace(plain, r"\.[mc]?jsx?$", ""), F.lit(e)) for e in (".ts", ".tsx")))
    tried = F.when(F.col("python"), python).when(F.startswith("target", F.lit(".")), script)
    return asked.select("directory", "python", "target", F.posexplode(tried).alias("rank", "module"))


def module_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each module that a file names (path, target): path, target and module. Scripts: relative names with or without ending; Python: dotted names below any directory above the file, the nearest first."""
    return linked(asked.select("path", "target").distinct(), files).where("module is not null")


def linked(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (path, target, more) with the file of the module that each names, null where none is known."""
    named = rows.where("target is not null")
    found = _cut(rows.sparkSession, tried_modules(named).join(files.select(F.col("path").alias("module")).distinct(), "module"))
    if not found.groupBy("directory", "python", "target").count().where("count > 1").isEmpty():  # else there is nothing to sort for it
        found = found.groupBy("directory", "python", "target").agg(F.min_by("module", "rank").alias("module"))
    led = _from_where(named).join(found.drop("rank"), ["directory", "python", "target"], "left").select(*rows.columns, "module")
    return led.union(rows.where("target is null").withColumn("module", F.lit(None).cast("string")))


def providers(links: DataFrame) -> DataFrame:
    """For each exported name (module, name): where its chain of exports and imports (`linked`) ends (at, own). Names renamed on the way are followed; reach doubles each round. Chains that go round, or whose module isn't known, are left out."""
    spark = links.sparkSession
    exports = links.where("kind = 'export'").select("path", "name", "other", "target", "module")
    imports = links.where("kind = 'import' AND module IS NOT NULL").select("path", F.col("name").alias("other"), F.col("module").alias("to"), F.col("other").alias("to_name"))
    named = exports.where("name != '*' AND (target IS NULL OR module IS NOT NULL)")
    step = named.join(imports, ["path", "other"], "left")
    node = lambda m, name: F.concat(m, F.lit("\n"), name)
    own = F.concat(F.lit("\n"), node("path", "other"))
    dst = F.when(F.col("target").isNotNull(), node("module", "other")).when(F.col("to").isNotNull(), node("to", "to_name")).otherwise(own)
    links = step.select("path", "name", dst.alias("dst")).groupBy("path", "name").agg(F.min("dst").alias("dst"), F.countDistinct("dst").alias("ways")).where("ways = 1").drop("ways")
    links = _cut(spark, links)
    stars = _cut(spark, exports.where("name = '*' AND module IS NOT NULL").select("path", "module").distinct())
    fresh = links.select("path", "name")
    while not stars.isEmpty():
        more = stars.join(fresh.select(F.col("path").alias("module"), "name"), "module").where("name != 'default'").select("path", "name", node("module", "name").alias("dst"))
        more = more.groupBy("path", "name").agg(F.min("dst").alias("dst"), F.countDistinct("dst").alias("ways")).where("ways = 1").drop("ways").join(links.select("path", "name"), ["path", "name"], "left_anti")
        more = _cut(spark, more)
        if more.isEmpty():
            break
        links, fresh = _cut(spark, links.union(more)), more.select("path", "name")
    edges = links.select(node("path", "name").alias("src"), "dst")
    ended = follow(edges, edges.select(F.col("src").alias("node"))).where("startswith(end, '\n')")
    parts, place = F.split("name", "\n"), F.split("end", "\n")
    return ended.select(parts[0].alias("module"), parts[1].alias("name"), place[1].alias("at"), place[2].alias("own"))


class Resolved(NamedTuple):
    """uses: references (path, name, member, removable, line, use) with what they name: at (the declaring file) and own, of (the name there and the members used on it); null at for names that lead nowhere known. taken: names that files import (path, name), the module they name it from (module, asked), and where it is declared (at, own). imports: names that files import, with that, and `*` for a module itself. ends: `providers`."""

    uses: DataFrame
    taken: DataFrame
    imports: DataFrame
    ends: DataFrame


def resolved(table: DataFrame, files: DataFrame) -> Resolved:
    """What the references and imports of a corpus name.

    A name that a module imports is followed to where it is declared; any other is the module's own. A member of a module's name is that module's export.
    """
    spark = table.sparkSession
    links = _cut(spark, linked(table.where("kind in ('import', 'export')").select("path", "kind", "name", "target", "other"), files))
    ends = _cut(spark, providers(links))
    imports = links.where("kind = 'import'").select("path", "name", F.col("other").alias("imported"), "module")
    if not imports.groupBy("path", "name").count().where("count > 1").isEmpty():  # else there is nothing to sort for it
        imports = imports.groupBy("path", "name").agg(F.min("imported").alias("imported"), F.min("module").alias("module"))
    # an import leads where it leads for all of its uses; one whose module isn't known has a key of its own, so such imports don't meet in one task
    imports = imports.withColumn("_module", F.coalesce("module", F.concat(F.lit("\n"), "path")))
    imports = _cut(spark, imports.join(ends.select(F.col("module").alias("_module"), F.col("name").alias("imported"), "at", "own"), ["_module", "imported"], "left").drop("_module"))
    uses = table.where("kind = 'reference'").select("path", "name", "member", "removable", "line", F.col("other").alias("use"))
    taken = links.where("kind = 'import' AND other != '*' AND module IS NOT NULL").select("path", "name", "module", F.col("other").alias("asked"))
    return Resolved(led_by(uses, imports, ends), taken.join(ends.withColumnRenamed("name", "asked"), ["module", "asked"]), imports, ends)


def led_by(uses: DataFrame, imports: DataFrame, ends: DataFrame) -> DataFrame:
    """uses (path, name, member, more) with what they name: at, own and of."""
    told = uses.columns
    met = uses.join(imports.withColumn("_taken", F.lit(True)), ["path", "name"], "left")
    here = F.col("_taken").isNull()
    led = met.select(*told, F.when(here, F.col("path")).otherwise(F.col("at")).alias("at"), F.when(here, F.col("name")).otherwise(F.col("own")).alias("own"), F.col("member").alias("of"), "imported", "module")
    if imports.where("imported = '*'").isEmpty():
        return led.drop("imported", "module")
    # the module itself has no name of its own, a member of it is its export
    led = _cut(uses.sparkSession, led)
    space = F.coalesce(F.col("imported") == "*", F.lit(False))
    first, rest = F.regexp_extract("member", r"^([^.]*)", 1), F.regexp_extract("member", r"^[^.]*\.?(.*)$", 1)
    within = led.where(space).select(*told, F.coalesce("module", F.concat(F.lit("\n"), "path")).alias("module"), first.alias("asked"), rest.alias("of")).join(ends.withColumnRenamed("name", "asked"), ["module", "asked"], "left")
    return led.where(~space).drop("imported", "module").unionByName(within.select(*told, "at", "own", "of"))


def owner_and_name(own: Column, member: Column) -> list[Column]:
    """owner and name of a declaration: an entry's object (and the objects in it that hold it) and its key; "" and the constant itself for others."""
    above = F.regexp_extract(member, r"^(.*)\.[^.]*$", 1)
    owner = F.when(member == "", "").when(above == "", own).otherwise(F.concat(own, F.lit("."), above))
    return [owner.alias("owner"), F.when(member == "", own).otherwise(F.regexp_extract(member, r"([^.]*)$", 1)).alias("name")]


def key_tables(table: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """What `operators.resolve.resolve` takes: declarations (path, module, owner, name, key) and references (path, module, owner, name, removable).

    A use of a whole object is one of all its members, and isn't removable.
    """
    constants = table.where("kind = 'declaration'")
    declarations = constants.select("path", F.col("path").alias("module"), *owner_and_name(F.col("name"), F.col("member")), F.col("target").alias("key"))
    uses = resolved(table, files).uses.where("at is not null")
    named = constants.select(F.col("path").alias("at"), F.col("name").alias("own"), F.col("member").alias("declared"))
    met = uses.join(named, ["at", "own"]).where("declared = '' OR of = '' OR of = declared OR startswith(of, declared || '.') OR startswith(declared, of || '.')")
    sure = F.col("removable") & ((F.col("declared") == "") & (F.col("of") == "") | (F.col("declared") != "") & (F.col("of") == F.col("declared")))
    references = met.select("path", F.col("at").alias("module"), *owner_and_name(F.col("own"), F.col("declared")), sure.alias("removable"), met["name"].alias("root"), "member", "line")
    return {"declarations": declarations, "references": references}
