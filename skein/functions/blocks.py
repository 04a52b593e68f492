"""Where the blocks of a file end: one walk over its tokens, with a stack of what is open.

braces: { and }. ends: words that open a block (some only where a line begins) and end. named: words that open one
and "end <word>". indent: lines that stand further in. next: up to the next definition of the same rank. All styles
take masked code, so nothing in comments or strings counts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

_TOKEN = re.compile(r"\w+|[^\w\s]")


class Style(NamedTuple):
    kind: str = "braces"
    #: Words that open a block anywhere, and those that do only as the first word of a line.
    anywhere: frozenset[str] = frozenset()
    leading: frozenset[str] = frozenset()
    #: Of leading words, those whose line has a word of `anywhere` that opens the same block (while x do).
    double: frozenset[str] = frozenset()
    closers: frozenset[str] = frozenset(["end"])
    folded: bool = False
    #: Whether a body without braces ends with its line.
    lines: bool = False


def style(kind: str, anywhere: str = "", leading: str = "", double: str = "", closers: str = "end", folded: bool = False) -> Style:
    return Style(kind, *(frozenset(x.split()) for x in (anywhere, leading, double, closers)), folded)


class Token(NamedTuple):
    text: str
    start: int
    first: bool  # of its line
    line: int


def tokens(code: str) -> Iterator[Token]:
    line, at, fresh = 0, 0, True
    for m in _TOKEN.finditer(code):
        between = code[at : m.start()]
        if "\n" in between:
            line += between.count("\n")
            fresh = True
        yield Token(m[0], m.start(), fresh, line)
        at, fresh = m.end(), False


class Blocks:
    """The blocks of one file."""

    def __init__(self, code: str, how: Style) -> None:
        self.code, self.how = code, how
        self.close: dict[int, int] = {}  # from where a block opens to where it has ended
        self.opens: list[int] = []
        self.stops: list[int] = []  # where statements end outside brackets
        {"braces": self._braces, "ends": self._ends, "named": self._named}.get(how.kind, lambda: None)()
        self.opens.sort()

    def _braces(self) -> None:
        stack: list[tuple[str, int]] = []
        for t in tokens(self.code):
            if t.text in "{([":
                stack.append((t.text, t.start))
                if t.text == "{":
                    self.opens.append(t.start)
            elif t.text in "})]":
                opener = "{(["["})]".index(t.text)]
                if any(x[0] == opener for x in stack):
                    while stack[-1][0] != opener:  # brackets left open inside end here
                        stack.pop()
                    at = stack.pop()[1]
                    if opener == "{":
                        self.close[at] = t.start + 1
            elif t.text == ";" and (not stack or stack[-1][0] == "{"):
                self.stops.append(t.start + 1)

    def _ends(self) -> None:
        stack: list[int] = []
        how, led, before = self.how, -1, ""
        for t in tokens(self.code):
            word = t.text.lower() if how.folded else t.text
            label = self.code[t.start + len(word) : t.start + len(word) + 1] == ":" and word in how.anywhere  # do: opens nothing
            opens = word in how.anywhere and not label and before != "." or t.first and word in how.leading
            if opens and led == t.line and word not in how.leading:
                led = -1  # opened by the line's first word already
            elif opens:
                stack.append(t.start)
                self.opens.append(t.start)
                if t.first and word in how.double:
                    led = t.line
            elif word in how.closers and before != "." and stack:
                self.close[stack.pop()] = t.start + len(word)
            before = word

    def _named(self) -> None:
        stack: list[tuple[str, int]] = []
        held = list(tokens(self.code.lower()))
        words = self.how.leading
        k = 0
        while k < len(held):
            t = held[k]
            if t.text == "end":
                after = held[k + 1] if k + 1 < len(held) and held[k + 1].line == t.line else None
                if after is not None and after.text in words and any(x[0] == after.text for x in stack):
                    while True:
                        word, at = stack.pop()
                        self.close[at] = after.start + len(after.text)
                        if word == after.text:
                            break
                elif stack and (after is None or after.text == ";" or after.text not in _OTHER_ENDS):
                    self.close[stack.pop()[1]] = t.start + 3
                k += 2 if after is not None else 1
                continue
            if t.text in words and not (k and held[k - 1].text in ("exit", "declare") and held[k - 1].line == t.line):
                stack.append((t.text, t.start))
                self.opens.append(t.start)
            k += 1

    def _line_end(self, at: int) -> int:
        end = self.code.find("\n", at)
        return len(self.code) if end < 0 else end

    def end(self, start: int, after: int) -> int:
        """Where a definition ends whose head goes from start to after (its parameters included)."""
        kind, code = self.how.kind, self.code
        if kind == "indent":
            return self._indented(start)
        begin = code.rfind("\n", 0, start) + 1
        if kind == "braces":
            k = bisect_right(self.opens, after - 1)
            brace = self.opens[k] if k < len(self.opens) else len(code)
            s = bisect_right(self.stops, after)
            stop = self.stops[s] if s < len(self.stops) else len(code)
            closed = code.find("}", after)
            if closed >= 0:
                stop = min(stop, closed)
            head = code[after : min(brace, stop)]
            if self.how.lines and "\n" in head and head.split("\n", 1)[0].strip():
                return self._line_end(after)
            if "\n" in head and re.search(r"(?<![=<>!])=(?![=>])|<-", head.split("\n", 1)[0]) and head.split("\n", 1)[0].rstrip()[-1:] not in "=,(":
                return self._line_end(after)  # the body is an expression on the line
            return self.close.get(brace, len(code)) if brace < stop else min(stop, len(code))
        k = bisect_right(self.opens, begin - 1)
        while k < len(self.opens) and self.opens[k] <= self._line_end(after):
            if self.opens[k] in self.close:
                return self.close[self.opens[k]]
            k += 1
        return self._line_end(after)

    def _indented(self, start: int) -> int:
        begin = self.code.rfind("\n", 0, start) + 1
        own = len(self.code[begin:]) - len(self.code[begin:].lstrip(" \t")) if self.code[begin:].strip() else 0
        at = self._line_end(start)
        while at < len(self.code):
            end = self._line_end(at + 1)
            line = self.code[at + 1 : end]
            if line.strip() and len(line) - len(line.lstrip(" \t")) <= own:
                return at
            at = end
        return len(self.code)


#: What else ends with a word after end.
_OTHER_ENDS = frozenset("if do loop select case with while for forall where associate block critical record team enum using synclock get set property event operator try".split())


def returns(body: str) -> str:
    """What the return statements of a body (masked) tell: a word return with something after it on its line gives a value."""
    some = none = False
    waiting: Token | None = None
    for t in tokens(body):
        if waiting is not None:
            value = t.line == waiting.line and t.text not in (";", "}", "end")
            some, none, waiting = some or value, none or not value, None
        if t.text.lower() == "return":
            waiting = t
    none = none or waiting is not None
    return "mixed" if some and none else "returns_value" if some else "returns_none" if none else "no_explicit_return"
