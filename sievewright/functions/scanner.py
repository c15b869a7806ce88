"""Tokens of languages with braces: strings, comments, names, numbers and signs, with the text between them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

_TOKEN = re.compile(
    r"""(?P<gap>(?:[ \t\r\n\f\v﻿   ]+|//[^\n]*|/\*.*?\*/)+)
|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
|(?P<num>\d[\w.]*)
|(?P<id>[A-Za-z_$@][\w$]*)
|(?P<sign>===|:=|!==|\?\.(?!\d)|\?\?=?|=>|&&=?|\|\|=?|==|!=|<=|>=|\+\+|--|[+\-*/%&|^]=|\.\.\.|[{}()\[\];,.<>+\-*/%&|^!~?:=\#\\])""",
    re.S | re.X,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: After these a slash begins a regular expression.
_BEFORE_REGEX = frozenset({"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "return", "typeof", "case", "+", "==", "===", "!=", "!=="})
#: After these markup may begin.
_BEFORE_MARKUP = _BEFORE_REGEX | {"default", "??", "else", "yield"}


#: Go, Kotlin and Swift: statements end with lines, and strings differ from those of the other languages.
DIALECTS = ("go", "kt", "swift")
_ARROWS = re.compile(r"->|\?:")
_HASHED = re.compile(r'(#+)(?:""".*?"""|"[^\n]*?")\1', re.S)
_RUNE = re.compile(r"'(?:\\[^\n]|[^'\\\n])[0-9A-Fa-f]{0,8}'")


class Unreadable(ValueError):
    """Text that doesn't scan or whose brackets don't match."""


@dataclass(eq=False, slots=True)
class Token:
    kind: str
    text: str
    gap: str = ""
    #: True and False for a literal that a fold wrote.
    value: bool | None = None


_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_RAW = re.compile(r"""r(?:'''.*?'''|\"\"\".*?\"\"\"|'[^'\n]*'|"[^"\n]*")|@"(?:[^"]|"")*\"""", re.S)
_TRIPLE = re.compile(r"""\"\"\"(?:\\.|.)*?\"\"\"(?!")|'''(?:\\.|.)*?'''(?!')""", re.S)
_HOLED = re.compile(r'(?:\$@|@\$|\$)"')
_TAG = re.compile(r"<(?=[A-Za-z_$>])")
_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
#: A name, number or sign after blanks, if nothing but a token of `_TOKEN` can begin with its first character.
_PLAIN, _PLAIN_DIALECT = (
    re.compile(r"""([ \t\r\n]*)(?:((?:[A-Za-qs-z_]|r(?!['"]))[\w$]*)|(\d[\w.]*)|(===|:=|!==|=>|&&=?|\|\|=?|==|!=|>=|\+\+|[+*%&|^]=|\.\.\.|[{}()\[\];,.>+*%&|^!~:=\\]"""
               + more + "))") for more in (r"|\?\.(?!\d)|\?\?=?|--|-=|[-?#]", "")
)
#: Characters that other tokens than those of `_TOKEN` begin with, in any language and in dialects.
_RARE, _FOREIGN, _QUOTES = frozenset("`r@\"'$/<"), frozenset("`\"#'-?"), ("'", '"')
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)


class Tokens(list):
    """Tokens of a source, the dialect they were read in ("" for languages with semicolons), and the language, where it is told."""

    dialect = ""
    language = ""


class _Scanner:
    """Reads a source from left to right; markup in expressions (jsx) is read as tokens of kinds tag and markup."""

    def __init__(self, source: str, jsx: bool, dialect: str = ""):
        self.source, self.jsx, self.dialect = source, jsx, dialect
        self.out = Tokens()
        self.out.dialect = dialect
        self.at = 0

    def add(self, kind: str, end: int, gap: str = "") -> None:
        self.out.append(Token(kind, self.source[self.at : end], gap))
        self.at = end

    def code(self, until_brace: bool = False) -> str:
        """Tokens to the end, or to the brace that closes what was opened before; the text after the last token."""
        s, gap, stack, add = self.source, "", [], self.out.append
        plain = (_PLAIN_DIALECT if self.dialect else _PLAIN).match
        while self.at < len(s):
            m = plain(s, self.at)
            if m:  # most tokens begin with a character that no other kind of token begins with
                blank, word, number, sign = m.groups()
                if blank:
                    gap += blank
                if word:
                    add(Token("id", word, gap))
                elif number:
                    add(Token("num", number, gap))
                else:
                    if until_brace and not stack and sign == "}":
                        self.at = m.end() - 1
                        return gap
                    add(Token("sign", sign, gap))
                    if sign in _OPEN:
                        stack.append(sign)
                    elif sign in _CLOSE and (not stack or stack.pop() != _CLOSE[sign]):
                        raise Unreadable(f"{sign} closes nothing")
                self.at, gap = m.end(), ""
                continue
            if not self.rare(gap):
                m = _TOKEN.match(s, self.at)
                if not m:
                    raise Unreadable(f"character {self.at} begins no token")
                if m.lastgroup == "gap":
                    if self.dialect in ("kt", "swift") and any(c.startswith("/*") and "/*" in c[2:] for c in _BLOCK.findall(m[0])):
                        raise Unreadable("comments within comments")
                    gap += m[0]
                    self.at = m.end()
                    continue
                if until_brace and not stack and m[0] == "}":
                    return gap
                self.add(m.lastgroup, m.end(), gap)
                if m.lastgroup == "sign":
                    if m[0] in _OPEN:
                        stack.append(m[0])
                    elif m[0] in _CLOSE and (not stack or stack.pop() != _CLOSE[m[0]]):
                        raise Unreadable(f"{m[0]} closes nothing")
            gap = ""
        if stack or until_brace:
            raise Unreadable(f"{(stack or ['{'])[-1]} does not close")
        return gap

    def rare(self, gap: str) -> bool:
        """Read a token of a kind that `_TOKEN` doesn't have, if one begins here."""
        s, at = self.source, self.at
        c = s[at]
        if self.dialect and c in _FOREIGN and self.foreign(gap):
            return True
        if c not in _RARE or (c == "r" and s[at + 1 : at + 2] not in _QUOTES):
            return False
        if c == "`":
            self.add("tpl", _template(s, at), gap)
        elif m := _RAW.match(s, at):
            self.add("str", m.end(), gap)
        elif m := _TRIPLE.match(s, at):
            self.add("str", m.end(), gap)
        elif m := _HOLED.match(s, at):
            self.add("tpl", _holed(s, m.end(), "@" in m[0]), gap)
        elif c == "/" and s[at + 1 : at + 2] not in ("/", "*") and (self.out[-1].text if self.out else ";") in _BEFORE_REGEX and (m := _REGEX.match(s, at)):
            self.add("re", m.end(), gap)
        elif self.jsx and c == "<" and (self.out[-1].text if self.out else ";") in _BEFORE_MARKUP and _TAG.match(s, at):
            self.markup(gap)
        else:
            return False
        return True

    def foreign(self, gap: str) -> bool:
        """Read a token that only this dialect has, if one begins here."""
        s, at = self.source, self.at
        if s[at] == "`":
            end = s.find("`", at + 1)
            if end < 0:
                raise Unreadable("a quote does not end")
            self.add("str" if self.dialect == "go" else "id", end + 1, gap)
        elif s[at] == '"' and self.dialect != "go":
            end, holes = _quoted(s, at, self.dialect)
            self.add("tpl" if holes else "str", end, gap)
        elif s[at] == "#" and self.dialect == "swift" and (m := _HASHED.match(s, at)):
            self.add("tpl" if "(" in m[0] else "str", m.end(), gap)
        elif s[at] == "'" and (m := _RUNE.match(s, at)):
            self.add("str", m.end(), gap)
        elif self.dialect != "go" and (m := _ARROWS.match(s, at)) and (m[0] == "->" or self.dialect == "kt"):
            self.add("sign", m.end(), gap)
        else:
            return False
        return True

    def braces(self, gap: str = "") -> None:
        """A hole of markup: braces around code."""
        self.add("sign", self.at + 1, gap)
        gap = self.code(until_brace=True)
        self.add("sign", self.at + 1, gap)

    def space(self) -> str:
        m = _SPACE.match(self.source, self.at)
        self.at = m.end()
        return m[0]

    def markup(self, gap: str) -> None:
        """An element with its attributes and children."""
        s = self.source
        self.add("tag", self.at + 1, gap)
        name = _NAME.match(s, self.at)
        if name:
            self.add("id", name.end())
        while True:
            gap = self.space()
            if s.startswith("/>", self.at):
                return self.add("tag", self.at + 2, gap)
            if s.startswith(">", self.at):
                self.add("tag", self.at + 1, gap)
                break
            if s.startswith("{", self.at):
                self.braces(gap)
            elif s[self.at : self.at + 1] in ('"', "'"):
                end = s.find(s[self.at], self.at + 1)
                if end < 0:
                    raise Unreadable("an attribute does not end")
                self.add("str", end + 1, gap)
            elif s.startswith("=", self.at):
                self.add("tag", self.at + 1, gap)
            elif m := _NAME.match(s, self.at):
                self.add("id", m.end(), gap)
            else:
                raise Unreadable(f"character {self.at} begins no attribute")
        while self.at < len(s):
            if m := re.compile(r"</\s*([\w$.:-]*)\s*>").match(s, self.at):
                if m[1] != (name[0] if name else ""):
                    raise Unreadable(f"{m[0]} closes another element")
                return self.add("tag", m.end())
            if s[self.at] == "{":
                self.braces()
            elif s[self.at] == "<":
                self.markup("")
            else:
                self.add("markup", re.compile(r"[^<{]+").match(s, self.at).end())
        raise Unreadable("an element does not end")


def scan(source: str, jsx: bool = False, language: str = "") -> tuple[Tokens, str]:
    """Tokens, each with the text before it, and the text after the last. jsx: expressions may hold markup."""
    scanner = _Scanner(source, jsx, language if language in DIALECTS else "")
    tail = scanner.code()
    return scanner.out, tail


@lru_cache(maxsize=4)
def scanned(source: str, jsx: bool = False, language: str = "") -> tuple[Tokens, str]:
    """The same for readers alone: nobody may change these tokens. The last few are kept, as one fold reads its source and its result several times."""
    return scan(source, jsx, language)


def copied(tokens: Tokens) -> Tokens:
    """Tokens that may be changed."""
    out = Tokens([Token(t.kind, t.text, t.gap) for t in tokens])
    out.dialect, out.language = tokens.dialect, tokens.language
    return out


def _holed(source: str, at: int, verbatim: bool) -> int:
    """The place after an interpolated string whose text starts at `at`; quotes may stand in its holes."""
    i = at
    while i < len(source):
        if source.startswith(("{{", "}}"), i) or (verbatim and source.startswith('""', i)) or (not verbatim and source[i] == "\\"):
            i += 2
        elif source[i] == '"':
            return i + 1
        elif source[i] == "{":
            depth, i = 1, i + 1
            while i < len(source) and depth:
                if m := _QUOTED.match(source, i):
                    i = m.end()
                    continue
                depth += (source[i] == "{") - (source[i] == "}")
                i += 1
        elif source[i] == "\n" and not verbatim:
            break
        else:
            i += 1
    raise Unreadable("an interpolated string does not end")


def _quoted(source: str, at: int, dialect: str) -> tuple[int, bool]:
    """The place after a string of Kotlin or Swift that starts at `at`, and whether it has holes, in which quotes may stand."""
    quote = '"""' if source.startswith('"""', at) else '"'
    raw, hole = dialect == "kt" and len(quote) == 3, "${" if dialect == "kt" else "\\("
    close, holes, i = {"${": "}", "\\(": ")"}[hole], False, at + len(quote)
    while i < len(source):
        if source.startswith(quote, i):
            i += len(quote)
            while len(quote) == 3 and source.startswith('"', i):
                i += 1
            return i, holes
        if source.startswith(hole, i):
            depth, holes, i = 1, True, i + 2
            while i < len(source) and depth:
                if source[i] == '"':
                    i = _quoted(source, i, dialect)[0]
                    continue
                depth += (source[i] == hole[1]) - (source[i] == close)
                i += 1
        elif source[i] == "\\" and not raw:
            i += 2
        elif source[i] == "\n" and len(quote) == 1:
            break
        else:
            holes |= dialect == "kt" and source[i] == "$"
            i += 1
    raise Unreadable("a string does not end")


_BLOCK = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_QUOTED = re.compile(r"""\"(?:\\.|[^"\\\n])*\"|'(?:\\.|[^'\\\n])*'""")


def _template(source: str, at: int) -> int:
    """The place after a template literal that starts at `at`."""
    i = at + 1
    while i < len(source):
        if source[i] == "\\":
            i += 2
        elif source[i] == "`":
            return i + 1
        elif source.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(source) and depth:
                c = source[i]
                if c == "`":
                    i = _template(source, i)
                    continue
                if m := _QUOTED.match(source, i):
                    i = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    raise Unreadable("a template does not end")


def holes(literal: str, language: str) -> list[tuple[int, int]]:
    """Stretches of code in a string literal with holes."""
    mark = {"kt": "${", "swift": "\\(", "csharp": "{"}.get(language, "${")
    close, out, i = ")" if mark[-1] == "(" else "}", [], literal.find(literal[-1]) + 1
    while i < len(literal):
        if language == "csharp" and literal.startswith(("{{", "}}"), i):
            i += 2
        elif literal.startswith(mark, i):
            start = i = i + len(mark)
            depth = 1
            while i < len(literal):
                if literal[i] == "`" and language not in ("kt", "swift", "csharp"):
                    i = _template(literal, i)
                    continue
                if m := _QUOTED.match(literal, i):
                    i = m.end()
                    continue
                depth += (literal[i] == mark[-1]) - (literal[i] == close)
                if not depth:
                    break
                i += 1
            out.append((start, i))
        else:
            i += 2 if literal[i] == "\\" else 1
    return out


def text(tokens: list[Token], tail: str) -> str:
    return "".join(t.gap + t.text for t in tokens) + tail


def closing(tokens: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at i."""
    depth = 0
    for k in range(i, len(tokens)):
        if tokens[k].kind == "sign":
            depth += (tokens[k].text in _OPEN) - (tokens[k].text in _CLOSE)
            if not depth:
                return k
    raise Unreadable("a bracket does not close")


def opening(tokens: list[Token], i: int) -> int:
    """The place of the innermost bracket that is open at i; -1 at the top."""
    depth = 0
    for k in range(i - 1, -1, -1):
        if tokens[k].kind == "sign":
            depth += (tokens[k].text in _CLOSE) - (tokens[k].text in _OPEN)
            if depth < 0:
                return k
    return -1


def content(literal: str) -> str | None:
    """The text of a string literal without escapes or holes, else null."""
    inner = literal[1:-1]
    return None if "\\" in inner or (literal[0] == "`" and "${" in inner) else inner
