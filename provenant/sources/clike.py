"""Tokens, brackets and nested constructs of Go, TypeScript and JavaScript."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SPACE = re.compile(r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_WORD = re.compile(r"[^\W\d][\w$]*|[$#@][\w$]*|#?[_$\w]+")
_NUMBER = re.compile(r"\d[\w.]*")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?')
_MARK = re.compile(r"=>|:=|\.\.\.|\?\.|<-|&&|\|\||[=!<>]=+|\+\+|--|\+=|-=|.", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_OPEN, _CLOSE = "([{", ")]}"


@dataclass(frozen=True)
class Token:
    kind: str  # word, number, string, raw (backquoted), mark
    text: str
    start: int
    end: int
    line: int
    column: int


@dataclass(frozen=True)
class Construct:
    """A stretch of tokens first..last of some kind (func, if, loop, class ...)."""

    kind: str
    first: int
    last: int
    name: str | None = None
    detail: object = None


def _template_end(source: str, at: int) -> int:
    """End of a backquoted literal with ${} in it."""
    k = at + 1
    while k < len(source):
        if source[k] == "\\":
            k += 2
        elif source[k] == "`":
            return k + 1
        elif source.startswith("${", k):
            depth, k = 1, k + 2
            while k < len(source) and depth:
                c = source[k]
                if c == "`":
                    k = _template_end(source, k)
                    continue
                if c in "\"'":
                    k = _STRING.match(source, k).end()
                    continue
                depth += (c == "{") - (c == "}")
                k += 1
        else:
            k += 1
    return len(source)


def tokens(source: str, script: bool) -> list[Token]:
    """Tokens without white space and comments; script: with template literals and regular expressions."""
    out: list[Token] = []
    at, line, line_start = 0, 1, 0
    while at < len(source):
        space = _SPACE.match(source, at)
        if space:
            end, kind = space.end(), ""
        elif source[at] == "`":
            end = _template_end(source, at) if script else (source.find("`", at + 1) + 1 or len(source))
            kind = "raw"
        elif source[at] in "\"'":
            end, kind = _STRING.match(source, at).end(), "string"
        elif m := _NUMBER.match(source, at):
            end, kind = m.end(), "number"
        elif m := _WORD.match(source, at):
            end, kind = m.end(), "word"
        else:
            m = None
            before = out[-1] if out else None
            if script and source[at] == "/" and (before is None or before.kind == "mark" and before.text not in (")", "]", "}") or before.text in ("return", "typeof", "case", "of", "in")):
                m = _REGEX.match(source, at)
            kind = "string" if m else "mark"
            end = (m or _MARK.match(source, at)).end()
        text = source[at:end]
        if kind:
            out.append(Token(kind, text, at, end, line, at - line_start))
        if breaks := text.count("\n"):
            line += breaks
            line_start = at + text.rfind("\n") + 1
        at = end
    return out


class Source:
    """Tokens with matching brackets, and the constructs found in them."""

    def __init__(self, source: str, script: bool) -> None:
        self.source, self.t = source, tokens(source, script)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, tok in enumerate(self.t):
            if tok.kind == "mark" and tok.text in _OPEN:
                stack.append(k)
            elif tok.kind == "mark" and tok.text in _CLOSE and stack:
                o = stack.pop()
                self.match[o], self.match[k] = k, o
        for o in stack:  # never closed
            self.match[o] = len(self.t) - 1
        self.constructs: list[Construct] = []

    def at(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "word"

    def text(self, first: int, last: int) -> str:
        """Source from the first to the last token."""
        return self.source[self.t[first].start : self.t[last].end] if first <= last else ""

    def around(self, k: int) -> list[Construct]:
        """Constructs that hold token k, the innermost first."""
        return sorted((c for c in self.constructs if c.first <= k <= c.last), key=lambda c: (-c.first, c.last))

    def split(self, first: int, last: int, mark: str = ",") -> list[tuple[int, int]]:
        """Stretches between marks outside of brackets."""
        out, k, begin = [], first, first
        while k <= last:
            if self.t[k].kind == "mark":
                if self.t[k].text in _OPEN:
                    k = self.match.get(k, last)
                elif self.t[k].text == mark:
                    out.append((begin, k - 1))
                    begin = k + 1
            k += 1
        if begin <= last:
            out.append((begin, last))
        return [(a, b) for a, b in out if a <= b]

    def operand_start(self, k: int) -> int:
        """First token of the operand that ends before token k: names, dots, calls, indexes."""
        k -= 1
        while k >= 0:
            if self.at(k) in (")", "]") and k in self.match:
                k = self.match[k]
                if not (self.is_word(k - 1) or self.at(k - 1) in (")", "]")):
                    return k
                k -= 1
                continue
            if self.is_word(k) or self.t[k].kind in ("string", "raw", "number"):
                if self.at(k - 1) in (".", "?."):
                    k -= 2
                    continue
                return k
            return k + 1
        return 0
