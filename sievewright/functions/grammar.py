"""Errors of syntax in languages with braces: statements by their heads, expressions by climbing operator precedence.

The grammar is wider than each language (types are read as expressions, lists may hold what calls or literals or
parameters do), so that one parser reads nine of them. An error is counted, the reader goes on after the item or statement it is in, and a gate compares
counts: a rewrite with more errors than its source is refused. What the grammar doesn't know counts on both sides alike.
"""

from __future__ import annotations

from .scanner import _CLOSE, _OPEN, Tokens, scan

_WORDS = ("if", "while", "for", "switch", "when", "foreach", "using", "lock", "synchronized", "with", "guard", "repeat")
_DECLARED = frozenset({"function", "class", "interface", "enum", "struct", "fun", "func", "namespace", "module", "import", "package", "type", "extension", "protocol", "object", "typealias", "record", "mixin", "actor"})
_BINDS = frozenset({"const", "let", "var", "val", "final"})
_PREFIX = frozenset({"!", "-", "+", "~", "++", "--", "...", "&", "*", "await", "new", "typeof", "void", "delete", "yield", "throw", "try", "async", "case", "let", "var", "return", "const", "@", "#", "out", "ref", "in", "export", "default", "is", "as", "some", "any", "inout"})
#: How tightly operators bind; those of one number group to the left, but assignment, arrows and conditionals.
_RANK = {x: n for n, ops in enumerate((("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "&&=", "||=", "??=", ":=", "=>", "->"), ("?",), ("??", "?:"), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "instanceof", "in", "!in", "is", "!is", "as", "of", "satisfies", "by", "where", "extends", "implements", "throws"), ("<<", ">>", "..", "..<", "..."), ("+", "-"), ("*", "/", "%", "**"), ("::",))) for x in ops}
_RIGHT = frozenset({"=", "=>", "->", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "&&=", "||=", "??=", "**"})
#: Before these a word is an operand and nothing that stands before one.
_AFTER = frozenset({"", ")", ",", ";", "=", ".", ":", "]", "}", "=>", ">", "|", "?", "||", "&&", "==", "==="})
#: Signs that together are one operator.
_JOINED = (("-", ">"), ("<", "<"), ("*", "*"), (":", ":"))
_LABELLED = ("csharp", "dart", "swift")


class _Parser:
    def __init__(self, tokens: Tokens, language: str):
        self.t, self.language, self.errors = tokens, language, 0
        self.lines = language in ("go", "kt", "swift")
        self.match, stack = {}, []
        for k, t in enumerate(tokens):
            if t.kind == "sign" and t.text in _OPEN:
                stack.append(k)
            elif t.kind == "sign" and t.text in _CLOSE:
                self.match[stack.pop()] = k
        self.known: dict[tuple[int, str], int] = {}
        self.header = 0

    # -- tokens

    def at(self, i: int, end: int) -> str:
        t = self.t[i] if i < end else None
        return "" if t is None else t.text if t.kind in ("sign", "id", "tag") else "\0"

    def fresh(self, i: int) -> bool:
        return i < len(self.t) and "\n" in self.t[i].gap

    def glued(self, i: int, end: int) -> bool:
        return i < end and not self.t[i].gap

    def operator(self, i: int, end: int) -> tuple[str, int]:
        """The infix operator at i and how many tokens it has."""
        a, b = self.at(i, end), self.at(i + 1, end)
        if a == ">" and b in (">", ">=") and self.glued(i + 1, end):
            return ">>", 3 if self.at(i + 2, end) == ">" and self.glued(i + 2, end) else 2
        if a == "." and b == ".":
            return "..", 3 if self.at(i + 2, end) in ("<", ".", "?") else 2
        if (a, b) in _JOINED and self.glued(i + 1, end):
            return a + b, 2
        if a == "!" and b in ("in", "is") and self.language == "kt":
            return a + b, 2
        if a == "as" and b in ("?", "!") and self.glued(i + 1, end):
            return "as", 2
        return a, 1

    def error(self) -> None:
        self.errors += 1

    # -- statements

    def block(self, i: int, end: int) -> None:
        while i < end:
            k = self.statement(i, end)
            i = k if k > i else i + 1

    def body(self, i: int, end: int) -> int:
        """A statement that has to be there."""
        if i >= end or self.at(i, end) in ("else", ")", "]", ","):
            self.error()
            return i
        return self.statement(i, end)

    def bracketless(self, i: int, end: int, least: bool) -> int:
        """A header without brackets and the block after it; the place after the header."""
        self.header += 1
        k = i
        while k < end and self.at(k, end) not in ("{", "else"):
            if self.at(k, end) in (";", ","):
                k += 1
                continue
            n = self.expression(k, end)
            if n == k:
                self.error()
                n = k + 1
            k = n
        self.header -= 1
        if least and k == i:
            self.error()
        return k

    def headed(self, i: int, end: int) -> int:
        """if, while, for and their like: header, statement, and else."""
        word = self.at(i, end)
        if word == "guard":
            k = self.bracketless(i + 1, end, True)
            return self.body(k + 1, end) if self.at(k, end) == "else" else self.missing(k)
        if self.language in ("go", "swift") or (self.at(i + 1, end) != "(" and self.at(i + 1, end) != "await"):
            k = self.bracketless(i + 1, end, word in ("if", "while"))
            if self.at(k, end) != "{":
                return self.missing(k)
            k = self.body(k, end)
        else:
            o = i + 2 if self.at(i + 1, end) == "await" else i + 1
            if self.at(o, end) != "(":
                return self.missing(o)
            close = self.match[o]
            if word in ("if", "while", "switch", "when") and close == o + 1:
                self.error()
            self.list(o + 1, close, ":")
            if word == "while" and self.at(close + 1, end) in ("", ";", "}"):  # the end of a do, or a loop without a body
                return close + 1
            k = self.body(close + 1, end)
        if word == "if" and self.at(k, end) == ";" and self.at(k + 1, end) == "else":
            k += 1
        if word == "if" and self.at(k, end) == "else":
            k = self.body(k + 1, end)
        while word in ("for", "while") and self.at(k, end) == "else":
            self.error()
            k += 1
        return k

    def missing(self, i: int) -> int:
        self.error()
        return i

    def declared(self, i: int, end: int) -> int:
        """A declaration by its word: parameters, types and bodies, to its end."""
        k = i + 1
        while k < end:
            x = self.at(k, end)
            if x == "{":
                self.braces(k)
                k = self.match[k] + 1
                if self.at(k, end) in (",", "from", "=", "as") or (self.at(k, end) in ("&", "|") and self.language in ("ts", "tsx")):
                    continue
                return k
            if x in ("(", "["):
                self.list(k + 1, self.match[k], ":")
                k = self.match[k] + 1
            elif x in ("=", "=>") and self.at(i, end) != "type":
                return self.ended(self.expression(k + 1, end), end)
            elif x == ";":
                return k + 1
            elif k > i + 1 and self.fresh(k) and x not in (":", ".", "extends", "implements", "where", "with", ",", "|", "&", "from", "<", "throws") and self.at(k - 1, end) not in (",", ":", "|", "&", "extends", "implements", "="):
                return k
            else:
                k += 1
        return k

    def statement(self, i: int, end: int) -> int:
        x, after = self.at(i, end), self.at(i + 1, end)
        if x in (";", ","):
            return i + 1
        if x == "{" and self.t[i].kind == "sign":
            self.braces(i)
            return self.ended(self.tail(self.match[i] + 1, end), end)
        if x == "else" and after == "->":
            return self.body(i + 2, end)
        if x in ("else", "catch", "finally") and after != ":" and after != "(" or x == "else":
            self.error()
            return i + 1
        if self.t[i].kind == "id" and after not in (".", "=", ":", ",", ")") or (x in ("default", "case") and after == ":"):
            if x in _WORDS and (x != "repeat" or after == "{") and not (x in ("with", "using", "lock", "when", "synchronized", "foreach") and after != "("  and not (x == "when" and after == "{")):
                return self.headed(i, end) if x not in ("repeat",) else self.looped(i, end)
            if x == "do" and self.language != "go":
                return self.looped(i, end)
            if x == "try" and after in ("{", "("):
                return self.tried(i, end)
            if x in ("case", "default"):
                return self.arm(i, end)
            if x in ("return", "throw", "break", "continue", "yield"):
                if i + 1 >= end or self.fresh(i + 1) or after in (";", "}"):
                    return i + 1
                if x in ("break", "continue"):
                    return self.ended(i + 2, end)
                k = self.expression(i + 1, end)
                while self.at(k, end) == "," and self.language == "go":
                    k = self.expression(k + 1, end)
                return self.ended(k, end)
            if x in _DECLARED and not (x in ("type", "object", "record", "module", "extension", "mixin", "actor", "namespace", "package") and (after in ("(", "[") or i + 1 >= end)):
                return self.declared(i, end)
            if x in _BINDS:
                return self.bound(i + 1, end)
        if after == ":" and self.t[i].kind == "id" and self.at(i + 2, end) != ":" and not self.lines:
            return i + 2  # a label, a key or a member with a type
        k = self.expression(i, end)
        while self.at(k, end) == "," and k > i:
            k = self.expression(k + 1, end)
        if self.at(k, end) == ":" and k > i and self.plain(i, k):
            return self.ended(self.expression(k + 1, end), end)  # a member or a return type
        return self.ended(k, end)

    def plain(self, i: int, k: int) -> bool:
        """Whether tokens are names, brackets and marks of optional ones alone, as before a type."""
        while i < k:
            if self.t[i].text not in ("?", "!", "*", "@", "#", ".", "...", "-") and self.t[i].kind not in ("id", "str", "num") and i not in self.match:
                return False
            i = self.match.get(i, i) + 1
        return True

    def bound(self, i: int, end: int) -> int:
        """What a binding binds, its types, and its values."""
        k = i
        while k < end:
            x = self.at(k, end)
            if x in ("=", ":="):
                k = self.expression(k + 1, end)
                while self.at(k, end) == "," and self.language in ("go", "kt") and k < end:
                    k = self.expression(k + 1, end)
                if self.at(k, end) != ",":
                    return self.ended(k, end)
            elif x in (";", "}", "in", "of") or (k > i and self.fresh(k) and x not in ("(", "[", "{", ":", ",", ".", "|", "&", "<") and self.at(k - 1, end) not in (",", ":", "|", "&", "<", "=")):
                return k + 1 if x == ";" else self.expression(k + 1, end) if x in ("in", "of") else k
            elif k in self.match:
                self.list(k + 1, self.match[k], ":") if x != "{" else self.braces(k, "either")
                k = self.match[k] + 1
            else:
                k += 1
        return k

    def looped(self, i: int, end: int) -> int:
        k = self.body(i + 1, end)
        if self.at(k, end) == "while":
            if self.at(k + 1, end) == "(" and self.language != "swift":
                close = self.match[k + 1]
                if close == k + 2:
                    self.error()
                self.list(k + 2, close, "")
                return self.ended(close + 1, end)
            return self.ended(self.expression(k + 1, end), end)
        return self.tried(i, end, k) if self.language == "swift" else self.missing(k)

    def tried(self, i: int, end: int, k: int = 0) -> int:
        if not k:
            k = i + 1
            if self.at(k, end) == "(":
                self.list(k + 1, self.match[k], ":")
                k = self.match[k] + 1
            k = self.body(k, end)
        found = 0
        while self.at(k, end) in ("catch", "finally", "on"):
            found += 1
            while k < end and self.at(k, end) != "{":
                if k in self.match:
                    self.list(k + 1, self.match[k], ":")
                k = self.match.get(k, k) + 1
            k = self.body(k, end)
        if not found and self.language not in ("swift", "java", "csharp"):
            self.error()
        return k

    def arm(self, i: int, end: int) -> int:
        """The label of an arm of a switch."""
        k, depth = i + 1, 0
        while k < end:
            x, n = self.operator(k, end)
            if x in ("->", "=>"):
                return k + n
            if x == "?" and self.at(k + 1, end) not in (",", ":", "."):
                depth += 1
            if x == ":":
                if not depth:
                    return k + 1
                depth -= 1
            if x in (";", "="):
                return self.ended(self.expression(k + 1, end), end) if x == "=" else k + 1
            if self.fresh(k) and self.language == "swift" and self.at(k - 1, end) != ",":
                return k
            k = self.match.get(k, k) + 1 if k in self.match else k + n
        return k

    def ended(self, i: int, end: int) -> int:
        """A statement has to end here; the place after it."""
        if i >= end or self.fresh(i) or self.at(i, end) in (";", "}") or (i and self.t[i - 1].text == "}"):
            return i + 1 if self.at(i, end) == ";" else i
        x = self.at(i, end)
        if x == "else" or (self.language == "go" and self.t[i].kind == "str"):
            return i if x == "else" else i + 1
        if self.t[i].kind == "id" and x not in ("true", "false", "null", "nil") and self.t[i - 1].kind in ("id", "sign"):
            return self.statement(i, end)  # a type and a name, a modifier, an infix word
        if x == "{":
            self.braces(i)
            return self.ended(self.match[i] + 1, end)
        self.error()
        while i < end and self.at(i, end) != ";" and not self.fresh(i):
            i = self.match.get(i, i) + 1
        return i

    # -- expressions

    def expression(self, i: int, end: int, least: int = 0) -> int:
        k = self.operand(i, end)
        while k < end:
            x, n = self.operator(k, end)
            rank = _RANK.get(x)
            if self.t[k].kind == "id" and rank is not None and x not in _RANK:
                break
            if rank is None and self.language == "kt" and self.t[k].kind == "id" and not self.fresh(k) and k + 1 < end and not self.fresh(k + 1) and x not in ("else", "get", "set") and (self.t[k + 1].kind in ("id", "num", "str", "tpl") or self.at(k + 1, end) in ("(", "{", "-")):
                x, rank = "infix", 10
            if rank is None or rank < least or (self.lines and self.fresh(k) and x in ("-", "+", "*", "&", "<")):
                break
            if x == "?":
                if self.nullable(k, end):
                    k = self.tail(k + 1, end)
                    continue
                k = self.expression(k + 1, end)
                if self.at(k, end) != ":":
                    self.error()
                    break
                k = self.expression(k + 1, end, rank)
                continue
            if x in ("=>", "->") and self.at(k + n, end) == "{":
                self.braces(k + n)
                k = self.tail(self.match[k + n] + 1, end)
                continue
            if x == "<" and self.at(k + 1, end) == ">":
                k = self.tail(k + 2, end)
                continue
            if x == ">" and (self.at(k + 1, end) in ("", ",", ")", ";", "=", "{", "[", "?", ".", "]", "}", ">", ":", "=>") or self.fresh(k + 1)):
                k += 1  # the end of type arguments
                k = self.tail(k, end)
                continue
            if x == ">>" and (self.at(k + n, end) in ("", ",", ")", ";", "=", "{", "[", "?", "(", ".", ">") or self.fresh(k + n)):
                k = self.tail(k + n, end)
                continue
            if x in ("is", "as", "in", "!is", "!in", "instanceof", "satisfies", "extends", "implements", "throws", "where", "by", "of") and self.t[k].kind != "id" and not x.startswith("!"):
                break
            k = self.expression(k + n, end, rank + (x not in _RIGHT))
        return k

    def nullable(self, k: int, end: int) -> bool:
        """Whether the mark at k follows a type or a name that may be absent, rather than a condition."""
        after = self.at(k + 1, end)
        return after in ("", ")", ",", ";", ">", "]", "}", "=", ":", "?", "|", "{") or (self.glued(k, end) and (after in (".", "[", "(") and self.language in ("swift", "csharp", "kt") or self.language in ("swift", "csharp", "dart", "kt", "java") and not self.condition(k, end)))

    def condition(self, k: int, end: int) -> bool:
        """Whether a colon answers the mark at k."""
        depth, i = 0, k + 1
        while i < end and self.at(i, end) not in (";", ","):
            if self.at(i, end) == "?":
                depth += 1
            if self.at(i, end) == ":":
                if not depth:
                    return True
                depth -= 1
            i = self.match.get(i, i) + 1
        return False

    def operand(self, i: int, end: int) -> int:
        k = i
        while k < end and (self.at(k, end) in _PREFIX or (self.language == "swift" and self.at(k, end) == ".")) and not (self.t[k].kind == "id" and self.at(k + 1, end) in _AFTER and (self.at(k, end) != "try" or self.at(k + 1, end) != "?")):
            if self.at(k, end) in ("yield", "return", "try") and self.fresh(k + 1):
                break
            k += 2 if self.at(k, end) == "try" and self.at(k + 1, end) in ("?", "!") else 1
        if k >= end:
            return k if k > i and self.t[k - 1].kind == "id" else self.missing(k)
        t, x = self.t[k], self.at(k, end)
        if t.kind in ("num", "str", "tpl", "re"):
            k += 1
            while k < end and self.t[k].kind in ("str", "tpl") and t.kind in ("str", "tpl") and self.language in ("dart", "js", "ts", "tsx") and self.language == "dart":
                k += 1
            return self.tail(k, end)
        if t.kind == "tag":
            return self.element(k, end)
        if x == "(":
            close = self.match[k]
            after = self.at(close + 1, end)
            self.list(k + 1, close, ":" if after in ("=>", ":", "{", "->") or self.operator(close + 1, end)[0] == "->" or self.language in ("swift", "dart") else "")
            k = close + 1
            if self.language in ("java", "csharp", "dart", "ts", "tsx", "go") and k < end and not self.fresh(k) and (self.t[k].kind in ("num", "str", "tpl") or (self.t[k].kind == "id" and self.at(k, end) not in _RANK and self.language in ("java", "csharp")) or (self.at(k, end) in ("(", "!") and self.language in ("java", "csharp"))) and self.plain(self.match_open(close) + 1, close):
                return self.operand(k, end)  # a cast
            if self.at(k, end) == ":" and self.arrowed(k, end):
                while self.operator(k, end)[0] not in ("=>", "->", "{") and k < end:
                    k = self.match.get(k, k) + 1
            return self.tail(k, end)
        if x == "[":
            self.list(k + 1, self.match[k], ":")
            k = self.match[k] + 1
            if self.language == "go" and k < end and not self.fresh(k) and (self.t[k].kind == "id" or self.at(k, end) in ("*", "[")):
                return self.operand(k, end)  # a type of slices
            return self.tail(k, end)
        if x == "{":
            self.braces(k, "either" if self.language in ("kt", "swift") else "literal")
            return self.tail(self.match[k] + 1, end)
        if x == "<" and self.language in ("ts", "tsx", "dart", "csharp", "java"):
            while k < end and self.at(k, end) != ">":
                k = self.match.get(k, k) + 1
            return self.operand(k + 1, end)
        if x == "?" and self.language == "java" and self.t[k - 1].text in ("<", ","):
            return k + 1  # any type
        if t.kind != "id":
            return self.missing(k)
        if x in ("function", "class", "fun", "func", "object") and self.at(k + 1, end) not in (".", ",", ")", "=", ";", ""):
            while k < end and self.at(k, end) not in ("{", "=", ";"):
                if k in self.match:
                    self.list(k + 1, self.match[k], ":")
                k = self.match.get(k, k) + 1
            if self.at(k, end) != "{":
                return k
            self.braces(k)
            return self.tail(self.match[k] + 1, end)
        if x in ("if", "when", "switch", "for", "do", "try") and self.language in ("kt", "swift", "dart", "java", "csharp") and self.at(k + 1, end) not in (".", ","):
            return self.inline(k, end)
        if x in ("else", "catch", "finally", "while") and self.at(k + 1, end) != "(":
            return self.missing(k)
        return self.tail(k + 1, end)

    def match_open(self, close: int) -> int:
        return next(o for o, c in self.match.items() if c == close)

    def arrowed(self, k: int, end: int) -> bool:
        """Whether an arrow or a body follows the type at k."""
        i = k + 1
        while i < end and self.at(i, end) not in (",", ";", "=", "?", ":"):
            if self.operator(i, end)[0] in ("=>", "->", "{"):
                return True
            i = self.match.get(i, i) + 1
        return False

    def inline(self, k: int, end: int) -> int:
        """if, when and switch as operands; if and for within a list."""
        word = self.at(k, end)
        if word in ("do", "try"):
            return self.tried(k, end) if self.at(k + 1, end) == "{" else self.operand(k + 1, end)
        if self.language == "swift" or self.at(k + 1, end) != "(":
            k = self.bracketless(k + 1, end, word == "if")
        else:
            if word == "if" and self.match[k + 1] == k + 2:
                self.error()
            self.list(k + 2, self.match[k + 1], ":")
            k = self.match[k + 1] + 1
        if self.at(k, end) == "{":
            self.braces(k)
            k = self.match[k] + 1
        else:
            k = self.expression(k, end)
        if word == "if" and self.at(k, end) == "else":
            k = self.expression(k + 1, end)
        return k

    def tail(self, k: int, end: int) -> int:
        """What follows an operand: members, calls, places, marks."""
        while k < end:
            x = self.at(k, end)
            if x in (".", "?.") and self.at(k + 1, end) != ".":
                if x == "?." and self.at(k + 1, end) in ("(", "["):
                    k += 1
                elif k + 1 < end and (self.t[k + 1].kind in ("id", "num") or self.at(k + 1, end) in ("#", "*", "(", "<", "class")):
                    k += 1 if self.at(k + 1, end) in ("(", "<") else 2
                else:
                    return self.missing(k + 1)
            elif x in ("(", "[") and not (self.lines and self.fresh(k)):
                close = self.match[k]
                before = self.t[k - 1]
                if before.kind in ("num", "str") and x == "(" and not self.fresh(k):
                    self.error()
                after = self.operator(close + 1, end)[0]
                self.list(k + 1, close, ":" if x == "[" or self.language in _LABELLED or after in ("{", "=>", ":", "->", "throws", "=") else "")
                k = close + 1
            elif x == "{" and not self.header and not self.fresh(k) and self.t[k - 1].kind in ("id", "sign") and self.t[k - 1].text not in ("true", "false", "null", "nil"):
                self.braces(k, "block" if self.t[k - 1].text == ")" or self.language in ("kt", "swift", "java", "csharp") else "either")
                k = self.match[k] + 1
            elif x in ("++", "--") and not self.fresh(k):
                k += 1
            elif x == "!" and self.glued(k, end) and self.language in ("ts", "tsx", "swift", "kt", "dart", "csharp") and self.at(k + 1, end) not in ("in", "is"):
                k += 1
            elif k < end and self.t[k].kind == "tpl" and self.glued(k, end):
                k += 1
            else:
                return k
        return k

    def element(self, k: int, end: int) -> int:
        """Markup: an element to its end; braces within hold expressions."""
        depth = 0
        while k < end:
            t = self.t[k]
            if t.kind == "tag":
                depth += (t.text == "<") - (t.text == "/>" or t.text.startswith("</"))
                k += 1
                if not depth:
                    return k
            elif k in self.match:
                self.list(k + 1, self.match[k], "")
                k = self.match[k] + 1
            else:
                k += 1
        return k

    def list(self, i: int, end: int, colon: str) -> None:
        """Items between commas (or semicolons): values, parameters, or keys with values where a colon may stand."""
        header, self.header = self.header, 0
        while i < end:
            if self.at(i, end) in (",", ";") or (self.at(i, end) == ":" and i + 1 == end):
                i += 1
                continue
            k, colons = self.expression(i, end), 0
            while k < end and self.at(k, end) not in (",", ";"):
                x = self.at(k, end)
                if x == ":" and (colon or self.language in _LABELLED) and (self.plain(i, k) or colon) and colons < 1 + (self.language == "go"):
                    colons += 1
                    k = self.expression(k + 1, end) if self.at(k + 1, end) not in (",", "", ";") else k + 1
                elif (self.t[k].kind == "id" and self.t[k - 1].text not in ("true", "false")) or x == "{" or (self.fresh(k) and self.lines):
                    n = self.expression(k, end)  # a type and its name, a modifier
                    if n == k:
                        break
                    k = n
                else:
                    self.error()
                    while k < end and self.at(k, end) not in (",", ";"):
                        k = self.match.get(k, k) + 1
            i = max(k, i + 1)
        self.header = header

    def braces(self, i: int, kind: str = "block") -> None:
        """A block, a literal with keys, or (either) whichever reads with fewer errors."""
        close, header = self.match[i], self.header
        if (i, kind) not in self.known:
            before, self.header, found = self.errors, 0, []
            for name in ("block", "literal") if kind == "either" else (kind,):
                self.errors = 0
                if name == "block":
                    self.block(i + 1, close)
                else:
                    self.list(i + 1, close, ":")
                found.append(self.errors)
                if not self.errors:
                    break
            self.known[i, kind] = min(found)
            self.errors, self.header = before, header
        self.errors += self.known[i, kind]


def errors(tokens: Tokens, language: str) -> int:
    """How many errors a source has whose brackets match."""
    parser = _Parser(tokens, language)
    parser.block(0, len(tokens))
    return parser.errors


def count_errors(source: str, language: str, jsx: bool = False) -> int:
    """The number of errors of a source; Unreadable if it doesn't scan."""
    tokens, _ = scan(source, jsx, language)
    return errors(tokens, language)
