"""Which statements can't be reached, for languages with braces and bracketed conditions.

A statement either can complete or not, by its structure: jumps don't; an endless loop does if a break leaves it; a conditional does
if a branch does; a labelled statement does if a break names it; try does if its block or a handler does, and its last block does. What isn't
known completes, so nothing is held dead that may run.
"""

from __future__ import annotations

from ..functions.scanner import _OPEN, Token, closing

#: Without one of these every statement completes.
_LEAVES = frozenset({"break", "continue", "return", "throw", "while", "for", "do"})
#: Languages read here; in the others conditions have no brackets or loops are written otherwise.
READ = ("ts", "tsx", "js", "java", "csharp", "dart")


class _Reach:
    def __init__(self, tokens: list[Token]):
        self.t, self.dead = tokens, []
        self.match, stack = {}, []
        for k, t in enumerate(tokens):
            if t.kind == "sign" and t.text in _OPEN:
                stack.append(k)
            elif t.kind == "sign" and t.text in _OPEN.values() and stack:
                self.match[stack.pop()] = k

    def text(self, k: int) -> str:
        return self.t[k].text if k < len(self.t) and self.t[k].kind in ("id", "sign") else ""

    def block(self, i: int, end: int, breaks: list[set]) -> bool:
        """Whether the statements from i to end complete; those after one that doesn't are noted."""
        while i < end:
            nxt, completes = self.statement(i, end, breaks)
            i = max(nxt, i + 1)
            if not completes:
                while i < end and self.text(i) == ";":
                    i += 1
                if i < end:
                    self.dead.append((i, end))
                return False
        return True

    def simple(self, i: int, end: int) -> int:
        """The place after a statement without structure; functions within it are read for themselves."""
        k = i
        while k < end:
            t = self.t[k]
            if k in self.match:
                if t.text == "{" and k and self.t[k - 1].text in (")", "=>"):
                    self.block(k + 1, self.match[k], [set()])
                else:
                    self.inner(k)
                k = self.match[k] + 1
                if self.t[k - 1].text == "}" and (k >= end or "\n" in self.t[k].gap or self.t[i].text in ("class", "function", "interface", "enum", "public", "private", "protected", "static", "export", "namespace")):
                    return k
            elif t.text == ";":
                return k + 1
            elif k > i and "\n" in t.gap and t.kind == "id" and (self.t[k - 1].kind in ("id", "num", "str", "tpl") or self.t[k - 1].text in (")", "]", "}")):
                return k
            else:
                k += 1
        return k

    def inner(self, k: int) -> None:
        """Bodies of functions within brackets."""
        j = k + 1
        while j < self.match[k]:
            if j in self.match:
                if self.t[j].text == "{" and self.t[j - 1].text in (")", "=>"):
                    self.block(j + 1, self.match[j], [set()])
                else:
                    self.inner(j)
                j = self.match[j]
            j += 1

    def jump(self, i: int, end: int) -> tuple[int, bool]:
        k = i + 1
        while k < end and self.text(k) != ";" and not ("\n" in self.t[k].gap and self.t[i].text in ("break", "continue")):
            if "\n" in self.t[k].gap and (k == i + 1 or (self.t[k].kind == "id" and (self.t[k - 1].kind != "sign" or self.t[k - 1].text in (")", "]", "}")))):
                break
            if k in self.match:
                if self.text(k) == "{" and self.t[k - 1].text in (")", "=>"):
                    self.block(k + 1, self.match[k], [set()])
                else:
                    self.inner(k)
            k = self.match.get(k, k) + 1
        return k + (self.text(k) == ";"), False

    def loop(self, i: int, end: int, breaks: list[set]) -> tuple[int, set]:
        """A loop's body; the place after it, and the names of the breaks in it that leave it ("" for those without a name)."""
        mine: set = set()
        nxt, _ = self.statement(i, end, [*breaks, mine])
        return nxt, mine

    def statement(self, i: int, end: int, breaks: list[set]) -> tuple[int, bool]:
        if i >= end:
            return i, True
        x = self.text(i)
        if x == "{":
            return self.match[i] + 1, self.block(i + 1, self.match[i], breaks)
        if self.t[i].kind == "id" and self.text(i + 1) == ":" and x not in ("default",):
            mine: set = set()
            nxt, completes = self.statement(i + 2, end, [*breaks, mine])
            if breaks:
                breaks[-1].update(n for n in mine if n != x and n)
            if self.text(i + 2) not in ("for", "while", "do", "switch") and "" in mine and breaks:
                breaks[-1].add("")
            return nxt, completes or x in mine
        if x in ("break", "continue"):
            label = self.text(i + 1) if self.text(i + 1) != ";" and i + 1 < end and "\n" not in self.t[i + 1].gap and self.t[i + 1].kind == "id" else ""
            if x == "break" and breaks:
                breaks[-1].add(label)
            return self.jump(i, end)
        if x in ("return", "throw"):
            return self.jump(i, end)
        if x == "if" and self.text(i + 1) == "(":
            self.inner(i + 1)
            nxt, a = self.statement(self.match[i + 1] + 1, end, breaks)
            if self.text(nxt) != "else" or nxt >= end:
                return nxt, True
            nxt, b = self.statement(nxt + 1, end, breaks)
            return nxt, a or b
        if x in ("while", "for") and self.text(i + 1) == "(":
            self.inner(i + 1)
            close = self.match[i + 1]
            nxt, left = self.loop(close + 1, end, breaks)
            if breaks:
                breaks[-1].update(n for n in left if n)
            words = [self.t[k].text for k in range(i + 2, close)]
            endless = (x == "while" and words == ["true"]) or (x == "for" and words == [";", ";"])
            return nxt, not endless or bool(left)
        if x == "do" and self.text(i + 1) == "{":
            nxt, left = self.loop(i + 1, end, breaks)
            if breaks:
                breaks[-1].update(n for n in left if n)
            if self.text(nxt) != "while" or self.text(nxt + 1) != "(":
                return nxt, True
            close = self.match[nxt + 1]
            endless = [self.t[k].text for k in range(nxt + 2, close)] == ["true"]
            return close + 1 + (self.text(close + 1) == ";"), not endless or bool(left)
        if x == "switch" and self.text(i + 1) == "(" and self.text(self.match[i + 1] + 1) == "{":
            o = self.match[i + 1] + 1
            left: set = set()
            self.arms(o, [*breaks, left])
            if breaks:
                breaks[-1].update(n for n in left if n)
            return self.match[o] + 1, True
        if x == "try" and self.text(i + 1) == "{":
            nxt, completes = self.statement(i + 1, end, breaks)
            while self.text(nxt) in ("catch", "on") and nxt < end:
                while nxt < end and self.text(nxt) != "{":
                    nxt = self.match.get(nxt, nxt) + 1
                nxt, more = self.statement(nxt, end, breaks)
                completes = completes or more
            if self.text(nxt) == "finally" and nxt < end:
                nxt, last = self.statement(nxt + 1, end, breaks)
                completes = completes and last
            return nxt, completes
        return self.simple(i, end), True

    def arms(self, o: int, breaks: list[set]) -> None:
        """The arms of a switch: each is read to the next label."""
        k, start, end = o + 1, None, self.match[o]
        while k < end:
            if self.t[k].kind == "id" and self.t[k].text in ("case", "default") and self.t[k - 1].text in ("{", "}", ";", ":"):
                if start is not None:
                    self.block(start, k, breaks)
                while k < end and self.text(k) not in (":", "{"):
                    k = self.match.get(k, k) + 1
                start = k + 1
            k = self.match.get(k, k) + 1
        if start is not None and start < end:
            self.block(start, end, breaks)


def unreachable(tokens: list[Token]) -> list[tuple[int, int]]:
    """Stretches of statements that can't be reached, in order; none within another."""
    if tokens.language not in READ or not any(t.text in _LEAVES for t in tokens):
        return []
    found = _Reach(tokens)
    found.block(0, len(tokens), [set()])
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(found.dead)):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out
